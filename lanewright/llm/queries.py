"""The registered queries of the training-data operators and the SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanewright.llm import decontaminate, fingerprint, html_extract, langid, license_scan, ngram_lm, packing, pii, prefix_trie, simhash, spelling, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.language_model_scores(_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.document_fingerprints(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_suffix_dedup, op3_decontamination, op4_lm_score, op5_html_extraction, op6_simhash, op7_fingerprint, op8_language_id, op9_pii, op10_best_fit_packing, op11_spelling_variants, op12_conversation_trie, op13_toxicity)
}


def _canonical(text: str) -> str:
    """The canonical form of license_scan in SQL."""
    x = f"translate(coalesce({text}, ''), '{license_scan.UPPER}', '{license_scan.LOWER}')"
    x = f"regexp_replace({x}, '{license_scan.FSF_NOTICE}', '', 'g')"
    x = f"' ' || regexp_replace(regexp_replace({x}, '{license_scan.COPYRIGHT_LINE}', '\\1', 'g'), '{license_scan.NOT_WORD.replace(chr(92) + 'n', '')}', '  ', 'g') || ' '"
    for other, kept in license_scan.SPELLINGS:
        x = f"replace({x}, ' {other} ', ' {kept} ')"
    return f"trim(replace({x}, '  ', ' '))"


def _known() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in license_scan.KNOWN)


_OP1 = f"""WITH known AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256({_canonical("text")}) AS digest FROM (VALUES {_known()}) k(license, text)) GROUP BY digest),
lines AS (SELECT k.doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT doc_id, sha256({_canonical("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) k JOIN known USING (digest) GROUP BY k.doc_id)
SELECT d.doc_id, d.digest, k.license, coalesce(l.notices, '') AS notices FROM (SELECT doc_id, CASE WHEN {_canonical("text")} <> '' THEN sha256({_canonical("text")}) END AS digest FROM documents) d
LEFT JOIN known k USING (digest) LEFT JOIN lines l ON l.doc_id = d.doc_id"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
_OP3 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT *, least(13, len(w)) AS n FROM i WHERE len(w) > 0))),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
hits AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw USING (g, n)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

_CRC_TABLE = "crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(256) r(i))"


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text of code points below 256, with crc_table in scope."""
    data = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"
    return f"xor(list_reduce(list_prepend(4294967295, CAST({data} AS BIGINT[])), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


_OP11 = f"""WITH RECURSIVE {_CRC_TABLE},
tokens AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
hashed AS (SELECT w, c, {_crc32("d || ':' || w")} AS h FROM tokens, crc_table WHERE length(w) >= 7),
words AS (SELECT w, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, c FROM hashed) GROUP BY w HAVING length(w) >= 7 AND sum(c) >= 2),
cuts AS (SELECT w, p, substr(w, 1, p) || substr(w, p + 2) AS v FROM words, unnest(range(length(w))) t(p)),
near AS (SELECT a.w, b.w AS o FROM cuts a JOIN cuts b ON a.p = b.p AND a.v = b.v AND a.w <> b.w UNION SELECT w, v FROM cuts WHERE v IN (SELECT w FROM words) UNION SELECT v, w FROM cuts WHERE v IN (SELECT w FROM words)),
best AS (SELECT near.w, count(*) AS n_near, arg_min(o, (-n, o)) AS form, max(n) AS form_n FROM near JOIN words ON near.o = words.w GROUP BY near.w),
forms AS (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (w)),
steps AS (SELECT w, form AS root, 1 AS k FROM forms WHERE form IS NOT NULL UNION ALL SELECT s.w, f.form, k + 1 FROM steps s JOIN forms f ON f.w = s.root WHERE f.form IS NOT NULL)
SELECT w AS word, form, coalesce(r.root, w) AS root, n, n_near, form_n FROM forms LEFT JOIN (SELECT w, arg_max(root, k) AS root FROM steps GROUP BY w) r USING (w)"""

_OP12 = f"""WITH {_CRC_TABLE},
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS i, g, t FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS t, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT c, max(i) AS n FROM turns GROUP BY c),
convs AS (SELECT c, c - c % 100 AS b, {_crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM own, crc_table),
rebuilt AS (SELECT v.c, i AS d, g, t FROM convs v JOIN turns r ON r.c = v.b AND i <= h UNION ALL SELECT v.c, i - h + least(h, coalesce(n, 0)), g, t FROM convs v JOIN turns r ON r.c = v.c AND i > h LEFT JOIN own ON own.c = v.b),
prefixes AS (SELECT c, d, sha256(string_agg(g, '') OVER (PARTITION BY c ORDER BY d)) AS k, t FROM rebuilt UNION ALL SELECT c, 0, '', 0 FROM convs),
nodes AS (SELECT k, min(c) AS c, min(d) AS d, min(t) AS t, count(*) AS n FROM prefixes GROUP BY k),
ends AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS e FROM (SELECT c, max_by(k, d) AS k FROM prefixes GROUP BY c) GROUP BY k),
up AS (SELECT n.k, p.k AS pk FROM nodes n JOIN prefixes p ON p.c = n.c AND p.d = n.d - 1),
kids AS (SELECT pk AS k, count(*) AS n_children FROM up GROUP BY pk),
below AS (SELECT p.k, count(*) FILTER (n_children IS NULL) AS n_leaves, CAST(sum((n.n - 1) * n.t) AS BIGINT) AS saved FROM nodes n LEFT JOIN kids USING (k) JOIN prefixes p ON p.c = n.c AND p.d <= n.d GROUP BY p.k)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, u.c AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nodes n JOIN below b USING (k) LEFT JOIN kids USING (k) LEFT JOIN ends USING (k) LEFT JOIN up ON up.k = n.k LEFT JOIN nodes u ON u.k = up.pk"""

#: The other operators train models, iterate to a fixed point or use hashes that SQL lacks; tests hold them against brute force.
ORACLE: dict[str, str] = {"op1_license_scan": _OP1, "op3_decontamination": _OP3, "op11_spelling_variants": _OP11, "op12_conversation_trie": _OP12}
