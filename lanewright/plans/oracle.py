"""Common table expressions of the SQL that checks the registered queries (DuckDB dialect)."""

from __future__ import annotations

from lanewright.functions.columns import SPACES
from lanewright.operators.audit import TOKENIZER
from lanewright.plans.params import FLOORS, LANES, STAGES, TRAIN_LANES, P
from lanewright.sources.tables import FIRST_OTHER, OTHERS

C, B = P.context, P.batch


def _literal(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)


def values(rows: list[tuple[object, ...]]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


def uniform(key: str) -> str:
    return f"(CAST(CAST('0x' || substr(sha256('{P.seed}:' || {key}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"


WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '')"


def ngrams(w: str, n: int | str) -> str:
    return f"list_transform(range(1, greatest(len({w}) - {n} + 2, 1)), lambda i: array_to_string({w}[i:i + {n} - 1], ' '))"


def ordered_hash(source: str, keys: str, order: str, value: str, width: int = P.block) -> str:
    """The two-level block hash of operators.ordered in SQL."""
    return f"""(SELECT {keys}, sha256(string_agg(v, chr(10) ORDER BY at2)) AS hash FROM (
      SELECT {keys}, at1 // {width} AS at2, sha256(string_agg(v, chr(10) ORDER BY at1)) AS v FROM (
        SELECT {keys}, r // {width} AS at1, sha256(string_agg({value}, chr(10) ORDER BY r)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}, {value}) - 1 AS r FROM {source}) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)"""


LOSS = f"round(greatest(0.01, 3.5 * exp(step * -0.08) + ({uniform("'loss:' || step")} - 0.5) * 0.1), 4)"
SAMPLE_LOSS = f"round(greatest(0.001, {LOSS} + ({uniform("'sample:' || step || ':' || sample_index")} - 0.5) * 0.04), 4)"

CTES = f"""
lanes(lane_idx, lane, is_eval, target, floor) AS {values([(k, *x) for k, x in enumerate(LANES)])},
stages(idx, stage, lo, hi) AS {values([(k, s, lo, hi) for k, (s, lo, hi, _) in enumerate(STAGES)])},
weights(stage, lane, weight) AS {values([(s, lane, w) for s, _, _, ws in STAGES for lane, w in zip(TRAIN_LANES, ws, strict=True)])},
floors(lane, floor) AS {values(list(FLOORS.items()))},
laned AS (SELECT d.doc_id, d.text, d.src, l.lane_idx, l.lane, l.is_eval, printf('%s_shard_%03d', l.lane, d.src) AS shard_id
          FROM (SELECT doc_id, text, CASE WHEN regexp_full_match(coalesce(source, ''), 'src[0-9]{{1,6}}') THEN CAST(substr(source, 4) AS INT) ELSE CAST(CAST('0x' || substr(sha256(coalesce(source, '')), 1, 6) AS BIGINT) % {OTHERS} * {len(LANES)} + {FIRST_OTHER} AS INT) END AS src FROM documents) d JOIN lanes l ON l.lane_idx = d.src % {len(LANES)}),
worded AS (SELECT *, {WORDS} AS w FROM laned),
tok AS (SELECT * EXCLUDE (text, w), CAST(len(w) AS BIGINT) AS n FROM worded),
offs AS (SELECT *, CAST(sum(n) OVER (PARTITION BY shard_id ORDER BY doc_id) - n AS BIGINT) AS off FROM tok),
over_ AS (SELECT * EXCLUDE (k), k AS seq, least(off + n, (k + 1) * {C}) - greatest(off, k * {C}) AS tokens, greatest(off, k * {C}) - k * {C} AS pos, greatest(off, k * {C}) - off AS skip
          FROM (SELECT *, unnest(range(off // {C}, (off + n - 1) // {C} + 1)) AS k FROM offs WHERE n > 0)),
seqs AS (SELECT lane_idx, lane, is_eval, src, shard_id, seq, CAST(sum(tokens) AS BIGINT) AS real, CAST({C} - sum(tokens) AS BIGINT) AS pad, count(*) AS n_sources FROM over_ GROUP BY ALL),
totals AS (SELECT lane_idx, lane, is_eval, src, shard_id, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, CAST(ceil(sum(n) / {C}.0) AS BIGINT) AS seqs FROM tok GROUP BY ALL),
bases AS (SELECT shard_id, CAST(sum(seqs) OVER (ORDER BY lane_idx, src) - seqs AS BIGINT) AS base FROM totals WHERE NOT is_eval),
tseqs AS (SELECT s.*, base + seq AS ord, (base + seq) // {B} AS batch_index FROM seqs s JOIN bases USING (shard_id)),
tover AS (SELECT o.*, base + seq AS ord, (base + seq) // {B} AS batch_index FROM over_ o JOIN bases USING (shard_id)),
batches AS (SELECT batch_index, batch_index AS step, printf('batch_%06d', batch_index) AS batch_id, count(*) AS seq_count, count(*) * {C} AS token_count, CAST(sum(real) AS BIGINT) AS real_token_count FROM tseqs GROUP BY ALL),
samples AS (SELECT batch_index, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY ord, pos, doc_id) AS sample_ids, count(*) AS n_samples FROM
            (SELECT batch_index, doc_id, min(ord) AS ord, arg_min(pos, ord) AS pos FROM tover GROUP BY ALL) GROUP BY ALL),
sources AS (SELECT batch_index, string_agg(shard_id, ',' ORDER BY first, shard_id) AS shard_sources FROM (SELECT batch_index, shard_id, min(ord) AS first FROM tover GROUP BY ALL) GROUP BY ALL),
sets AS (SELECT batch_index, string_agg(lane, ',' ORDER BY lane) AS datasets FROM (SELECT DISTINCT batch_index, lane FROM tover) GROUP BY ALL),
ledger AS (SELECT b.*, sample_ids, n_samples, shard_sources, datasets FROM batches b JOIN samples USING (batch_index) JOIN sources USING (batch_index) JOIN sets USING (batch_index)),
contrib AS (SELECT batch_index AS step, lane, CAST(sum(real) AS BIGINT) AS contrib_compat, CAST(sum(tokens) AS BIGINT) AS contrib_strict FROM tover JOIN (SELECT shard_id, seq, real FROM seqs) USING (shard_id, seq) GROUP BY ALL),
learn0 AS (SELECT batch_index AS step, CAST(ord % {B} AS INT) AS sample_index, real AS n_tokens, shard_id, lane, seq FROM tseqs),
learn AS (SELECT *, {LOSS} AS loss, {SAMPLE_LOSS} AS sample_loss FROM learn0),
cps AS (SELECT step, batch_id, step + 1 AS consumed, printf('checkpoint_step_%06d', step) AS name, sha256(step || '|' || batch_id || '|' || (step + 1)) AS state_hash FROM batches WHERE (step + 1) % {P.checkpoint_every} = 0 OR step = {P.crash_at}),
hashed AS (SELECT * EXCLUDE (text), sha256(coalesce(text, '')) AS h FROM laned),
contents AS {ordered_hash("hashed", "shard_id", "doc_id", "h")},
manifest AS (SELECT t.shard_id, t.lane AS dataset, t.docs AS document_count, c.hash AS content_hash, sha256('{TOKENIZER}') AS tokenizer_hash, t.src AS shard_index, t.is_eval FROM totals t JOIN contents c USING (shard_id)),
observed AS (SELECT shard_id, dataset, document_count + CASE WHEN shard_index % 7 = 3 THEN 1 ELSE 0 END AS document_count, CASE WHEN shard_index % 7 = 4 THEN reverse(content_hash) ELSE content_hash END AS content_hash,
             CASE WHEN shard_index % 7 = 5 THEN NULL ELSE tokenizer_hash END AS tokenizer_hash FROM manifest WHERE shard_index % 7 <> 6),
events_ AS (SELECT 'SHARD_ALLOWED' AS event, shard_id, lane AS dataset, 'training' AS used_for, false AS blocked, NULL AS reason FROM totals WHERE lane NOT IN ('EVAL', 'VALIDATION')
            UNION ALL SELECT 'FIREWALL_BLOCK', shard_id, lane, 'training', true, 'evaluation shard' FROM totals WHERE lane IN ('EVAL', 'VALIDATION')
            UNION ALL SELECT 'EVAL_SHARD_USED_FOR_EVAL', shard_id, lane, 'evaluation', false, NULL FROM totals WHERE lane IN ('EVAL', 'VALIDATION')),
scored AS (SELECT doc_id, round(least(1.0, greatest(0.0, CAST('0x' || substr(sha256(coalesce(text, '')), 1, 8) AS BIGINT) % 1000 / 1000.0 + ({uniform("'doc:' || doc_id")} - 0.5) * 0.1)), 4) AS score FROM laned WHERE lane = 'OPUS'),
decided AS (SELECT doc_id, score, CASE WHEN score >= {P.accept} THEN 'ACCEPT' WHEN score >= {P.defer} THEN 'DEFER' ELSE 'REJECT' END AS decision FROM scored),
steps40 AS (SELECT CAST(range AS INT) AS step FROM range({P.steps})),
pieced AS (SELECT lane_idx, lane, is_eval, src, shard_id, doc_id, seq, sha256(array_to_string(w[skip + 1:skip + tokens], ' ')) AS hash FROM over_ JOIN (SELECT doc_id, w FROM worded) USING (doc_id)),
seqhash AS (SELECT shard_id, seq, sha256(string_agg(hash, chr(10) ORDER BY doc_id)) AS hash FROM pieced GROUP BY ALL),
inputs AS (SELECT batch_index, sha256(string_agg(hash, chr(10) ORDER BY ord)) AS input_hash FROM tseqs JOIN seqhash USING (shard_id, seq) GROUP BY ALL),
prints AS (SELECT batch_index, batch_id, sha256(batch_id || '|' || batch_index || '|' || sample_ids || '|' || input_hash || '|' || seq_count) AS print FROM ledger JOIN inputs USING (batch_index))
"""


def sql(query: str, recursive: str = "") -> str:
    return f"WITH {CTES.strip()}\n{query}"
