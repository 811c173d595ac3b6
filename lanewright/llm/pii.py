"""Personal data by weak supervision, in DataFrame functions only.

Patterns wider than the base ones propose candidate spans of all four kinds: e-mail addresses with the signs spelled out,
IPv6 and broken-up IPv4 addresses, cards grouped by other signs or inside longer numbers, national telephone numbers.
Labelers vote on every candidate, base matches included: the form (check sums, ranges, well-formedness), a gazetteer
(domain endings, card issuers, country and area codes, address blocks), the words before it, and its shape.
Expectation-maximisation over the counts of vote patterns (at most 3^4 for a kind) estimates each labeler's reliability
without labels, from prior rates that count as PRIOR candidates; its posteriors train a logistic classifier over span
features, which decides on every candidate that no base pattern has. Base spans stay.

No pattern repeats a group greedily (Java's matcher recurses for that) or scans a run of its characters twice, so long
runs of digits, dots or letters take linear time. Possessive repeats change no match: what follows them cannot begin with
a character that they hold.

The spans of a text depend on the text alone, so equal texts are searched once (by MD5). Offsets come from the lengths of
the pieces between matches, summed by a window over one text's matches, which Spark spills if there are many. Texts
without a digit or an at sign meet no join; a text that very many rows share is split by Spark's skew join.

Defined cases: null or empty text has no span; repeated rows get equal rows; an added span that overlaps a base span or
any candidate kept that starts earlier (of two that start together: the longer, then the kind first in the alphabet) is
dropped; a classifier that is exactly undecided adds nothing; very long texts are searched whole; an empty table gives an
empty result; other columns are ignored, and `redact` returns them as they are.
"""

from __future__ import annotations

from itertools import product
from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.llm.common import broadcast_if_small, free_name, own_columns, quoted, texts, written

# The base patterns, in a form that matches the same and never recurses.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(BASE)
_AT, _DOT = r"(?:[ ]?[(\[{]at[)\]}][ ]?|[ ]at[ ])", r"(?:[ ]?[(\[{]dot[)\]}][ ]?|[ ]dot[ ])"
_SIGN = r"(?:\[\.\]|\(\.\)|[ ]?[(\[{]dot[)\]}][ ]?)"
#: Candidates beyond the base patterns. Prose like "the house at noon." is none: a bare "at" needs a spelled "dot".
WIDER = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:[ ]?[(\[{{]at[)\]}}][ ]?[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++|(?:@|{_AT})[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++)",
    "ip": rf"(?<![0-9A-Za-z:.])(?:[0-9]{{1,3}}{_SIGN}[0-9]{{1,3}}{_SIGN}[0-9]{{1,3}}{_SIGN}[0-9]{{1,3}}(?![0-9])|(?:[0-9A-Fa-f]{{1,4}})?(?::{{1,2}}[0-9A-Fa-f]{{1,4}}){{2,7}}+(?![0-9A-Za-z:]))",
    "card": r"(?<![0-9])(?:[0-9]{4}([\x20._/ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20._/ -])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.,/_-])(?:00[1-9][\x20().0-9/-]{6,20}(?<=[0-9])|\(0?[1-9][0-9]{1,3}\)[ ]?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}+|0[1-9][0-9]{0,4}+(?:[ ./-][0-9]{2,8}){1,4}+|[1-9][0-9]{2}([ .-])[0-9]{3}\1[0-9]{3,4})(?![0-9A-Za-z])",
}
# The gazetteers and the context words.
ENDINGS = "com org net edu gov info io dev biz co de at ch fr be es pt it nl uk ie eu us ca au in jp br mx".split()
COUNTRIES = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[013]|2[1-6][0-9]|85[0-9]|88[06]|9[6-9][0-9])"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|64[4-9]|65|35[2-8]|3[068]|62)"
BLOCKS = r"(?i)^(2[0-9a-f]{3}:|fe80:|f[cd][0-9a-f]{2}:|::1$|::ffff:|64:ff9b:)"
BEFORE = {
    "email": r"(?i)(e-?mail|contact|contacto|correo|courriel|kontakt|write to|reach|schreib\w*|escrib\w*)[^a-z]*$",
    "ip": r"(?i)(\bip(v[46])?|address|host|server|login|adresse|dirección|ping|from|gateway)[^a-z]*$",
    "card": r"(?i)(card|visa|mastercard|amex|karte|carte|tarjeta|account|konto|no|number|nr)[^a-z]*$",
    "phone": r"(?i)(phone|call|tel|mobile|cell|fax|telefon|handy|tél|téléphone|teléfono|móvil|llam\w*|appele\w*|anruf\w*)[^a-z]*$",
}
AGAINST = {
    "email": r"(?i)(meet|arrive\w*|look\w*|stay\w*)[^a-z]*$",
    "ip": r"(?i)(version|release|v|section|§|chapter|mac|time|at|um|uhr|ratio)[^a-z]*$",
    "card": r"(?i)(isbn|order|invoice|serial|tracking|rechnung|factura|facture)[^a-z]*$",
    "phone": r"(?i)(version|release|isbn|order|invoice|id|page|section|chapter|§|#|date|datum|rechnung|factura|facture)[^a-z]*$",
}
VOTES = ("v_form", "v_gazetteer", "v_context", "v_shape")
#: A feature for each side of each vote, and three of the span itself.
FEATURES = tuple(f"{v}_{side}" for v in VOTES for side in ("for", "against")) + ("f_wide", "f_brackets", "f_long")
CONTEXT = 24
#: For each labeler the rates that votes 1, -1, 0 have for true and false spans before any is seen, and how many candidates they count as.
RATES = (
    {1: (0.92, 0.10), -1: (0.03, 0.80), 0: (0.05, 0.10)},
    {1: (0.75, 0.35), -1: (0.05, 0.40), 0: (0.20, 0.25)},
    {1: (0.45, 0.10), -1: (0.03, 0.35), 0: (0.52, 0.55)},
    {1: (0.80, 0.35), -1: (0.05, 0.45), 0: (0.15, 0.20)},
)
PRIOR = 40.0
#: Rows of spans by text that are broadcast at most.
BROADCAST_ROWS = 100_000


def _matches(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """An array with, per match: the characters skipped since the match before, the match, and what stands before it."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(pieces.alias("gap"), found.alias("m"))
    rows = F.transform(both, lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["m"].alias("m"), F.right(x["gap"], F.lit(CONTEXT)).alias("before")))
    return F.transform(F.filter(rows, lambda x: x["m"].isNotNull()), lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("i"), x["gap"].alias("gap"), x["m"].alias("m"), x["before"].alias("before")))


def may_hold(text: Column) -> Column:
    """False only for texts in which no pattern can match."""
    return text.rlike(r"[0-9@]") | text.rlike(r"[(\[{]at[)\]}]") | F.contains(text, F.lit(" dot ")) | F.contains(text, F.lit("::"))


def candidates(docs: DataFrame) -> DataFrame:
    """key (MD5 of the text), kind, base (by which pattern), start, end, m, before: every match, in code points."""
    text = F.col("text")
    none = F.array().cast("array<struct<kind:string,base:boolean,i:int,gap:int,m:string,before:string>>")
    # Plain tests spare most texts the patterns.
    number = text.rlike("[0-9]")
    may = {"email": F.contains(text, F.lit("@")), "ip": number & text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+")) & number}
    wide = {
        "email": text.rlike(rf"[(\[{{]at[)\]}}]|{_DOT}"),
        "ip": text.rlike(rf"[0-9]{_SIGN}[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]{{1,4}}:|::[0-9A-Fa-f]"),
        "card": text.rlike(r"[0-9]{4}[\x20._/ -][0-9]{4}[\x20._/ -]?[0-9]"),
        "phone": text.rlike(r"[0-9][\x20)./-]{1,2}[0-9]{2}"),
    }
    lists = [F.when(may[k], _matches(text, BASE[k], k, True)).otherwise(none) for k in KINDS]
    lists += [F.when(wide[k], _matches(text, WIDER[k], k, False)).otherwise(none) for k in KINDS]
    some = docs.where(may_hold(text))
    rows = some.select(F.md5("text").alias("key"), F.concat(*lists).alias("all")).where(F.size("all") > 0).groupBy("key").agg(F.first("all").alias("all"))
    rows = rows.select("key", F.explode("all").alias("x")).select("key", "x.*")
    w = Window.partitionBy("key", "kind", "base").orderBy("i")
    end = F.sum(F.col("gap") + F.length("m")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end).select("key", "kind", "base", (F.col("end") - F.length("m")).alias("start"), "end", "m", "before")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled (9 taken off above 9), is a multiple of 10."""
    back = F.split(F.reverse(digits), "")
    value = lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.aggregate(F.transform(F.filter(back, lambda d: d != ""), lambda d, i: value(d.cast("int"), i)), F.lit(0), lambda s, x: s + x) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    """All parts are at most 255: up to 3 digits after leading zeros decide, longer parts are more."""
    value = lambda p: F.regexp_replace(p, "^0+", "")
    return ~F.exists(F.split(m, r"\."), lambda p: (F.length(value(p)) > 3) | (F.coalesce(value(p).try_cast("int"), F.lit(0)) > 255))


def valid_base(kind: Column, m: Column) -> Column:
    d = _digits(m)
    luhn = F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", _octets(m)).when(kind == "card", luhn).otherwise(F.length(d).between(8, 15))


def labelled(found: DataFrame) -> DataFrame:
    """key, kind, start, end, base, strict (a base span that stands), the votes (1 for, -1 against, 0 none) and the features (0 or 1)."""
    kind, m, before = F.col("kind"), F.col("m"), F.col("before")
    short = F.when(F.length(m) <= 400, m).otherwise("")  # no candidate of use is longer
    by_kind = lambda **x: F.when(kind == "email", x["email"]).when(kind == "ip", x["ip"]).when(kind == "card", x["card"]).otherwise(x["phone"])
    # Signs that were spelled out, put back.
    plain = F.when(kind == "email", F.regexp_replace(F.regexp_replace(short, _AT, "@"), _DOT, ".")).when(kind == "ip", F.regexp_replace(short, _SIGN, ".")).otherwise(short)
    rows = found.withColumns({"strict": F.col("base") & valid_base(kind, m), "plain": plain}).withColumn("digits", _digits(F.col("plain")))
    plain, d = F.col("plain"), F.col("digits")
    n, six = F.length(d), F.contains(plain, F.lit(":"))
    groups = F.size(F.split(plain, ":"))
    four = F.regexp_replace(plain, r"[.].*", "")
    octets = F.coalesce(F.split(plain, r"\."), F.array().cast("array<string>"))
    abroad = F.startswith(plain, F.lit("+")) | F.startswith(plain, F.lit("00"))
    country = F.regexp_replace(plain, r"^(\+|00)|[^0-9]", "").rlike(COUNTRIES)
    american = plain.rlike(r"^\(?[2-9][0-9]{2}[^0-9]{1,2}[2-9][0-9]{2}[^0-9][0-9]{4}$")
    national = plain.rlike(r"^\(?0[1-9]")
    spanish = plain.rlike(r"^[6789][0-9]{2}[ .-][0-9]{3}[ .-][0-9]{3}$")
    six_whole = plain.rlike(r"^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | (plain.rlike("::") & ~plain.rlike("::.*::") & (groups <= 8))
    sign = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    form = by_kind(
        email=sign(plain.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*[A-Za-z0-9]@[A-Za-z0-9]([A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}$") & ~plain.rlike(r"\.\.|-\.|\.-"), F.lit(True)),
        ip=sign(F.when(six, six_whole).otherwise((F.size(octets) == 4) & _octets(plain)), F.lit(True)),
        card=sign(n.between(13, 19) & F.when(n.between(13, 19), _luhn(d)).otherwise(False), F.lit(True)),
        phone=sign((n.between(8, 15) & (abroad | (national & (n >= 9)) | spanish)) | american, F.lit(True)),
    )
    first = four.try_cast("int")
    listed = by_kind(
        email=sign(F.lower(F.substring_index(plain, ".", -1)).isin(*ENDINGS), F.lit(True)),
        ip=F.when(six, sign(plain.rlike(BLOCKS), F.lit(False))).otherwise(sign(first.between(1, 223), F.lit(True))),
        card=sign(d.rlike(ISSUERS), F.lit(True)),
        phone=F.when(abroad, sign(country, ~country)).otherwise(sign(american | spanish | national, F.lit(True))),
    )
    near, against = F.lit(False), F.lit(False)
    for k in KINDS:
        near = F.when(kind == k, before.rlike(BEFORE[k])).otherwise(near)
        against = F.when(kind == k, before.rlike(AGAINST[k])).otherwise(against)
    brackets = m.rlike(r"[(\[{]")
    date = plain.rlike(r"^(19|20)[0-9]{2}[-/. ][0-9]{2}[-/. ][0-9]{2}|[-/. ](19|20)[0-9]{2}$|^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    shape = by_kind(
        email=sign(brackets | (F.contains(m, F.lit("@")) & ~plain.rlike(r"^[%+]|@.*[A-Z]{3}")), F.length(m) > 100),
        ip=F.when(six, sign((groups >= 4) & plain.rlike("[A-Fa-f]") & ~plain.rlike(r"^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"), F.lit(True))).otherwise(sign(F.exists(octets, lambda p: p.try_cast("int") > 31), F.forall(octets, lambda p: F.length(p) == 1))),
        card=sign(n.isin(15, 16) & ~plain.rlike(r"([0-9])\1{6}"), F.lit(True)),
        phone=sign(~date & plain.rlike(r"[0-9][\x20()./-]+[0-9]"), F.lit(True)),
    )
    votes = {"v_form": form, "v_gazetteer": listed, "v_context": sign(near, against), "v_shape": shape}
    rows = rows.withColumns(votes)
    sides = {f"{v}_{side}": (F.col(v) == x).cast("int") for v in VOTES for side, x in (("for", 1), ("against", -1))}
    own = {"f_wide": (~F.col("base")).cast("int"), "f_brackets": brackets.cast("int"), "f_long": F.when(kind == "email", F.length(m) > 64).otherwise(n > 12).cast("int")}
    return rows.withColumns(sides | own).select("key", "kind", "start", "end", "base", "strict", *VOTES, *FEATURES)


def em(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(share of true spans, for each labeler: vote -> its probability for true and for false spans)."""
    share, rates = 0.5, [dict(r) for r in RATES]
    for _ in range(rounds):
        sums = [{v: [PRIOR * x for x in both] for v, both in r.items()} for r in RATES]
        true, total = PRIOR / 2, PRIOR
        for votes, count in patterns:
            p = posterior(votes, share, rates)
            true += p * count
            total += count
            for k, v in enumerate(votes):
                sums[k][v][0] += p * count
                sums[k][v][1] += (1 - p) * count
        share = min(0.95, max(0.05, true / total))
        whole = [[sum(x[side] for x in s.values()) for side in (0, 1)] for s in sums]
        rates = [{v: (s[v][0] / t, s[v][1] / f) for v in s} for s, (t, f) in zip(sums, whole, strict=True)]
    return share, rates


def posterior(votes: tuple[int, ...], share: float, rates: list[dict[int, tuple[float, float]]]) -> float:
    z = log(share) - log(1 - share) + sum(log(r[v][0]) - log(r[v][1]) for r, v in zip(rates, votes, strict=True))
    return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def sides(votes: tuple[int, ...]) -> tuple[int, ...]:
    """The vote features of a vote pattern."""
    return tuple(int(v == x) for v in votes for x in (1, -1))


def logistic(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 300) -> list[float]:
    """Weights (bias first) for rows of features, positive and total weight; scaled gradient steps with a small ridge."""
    w = [0.0] * (len(FEATURES) + 1)
    total = sum(t for _, _, t in rows) or 1.0
    active = [[0, *(k + 1 for k, x in enumerate(f) if x)] for f, _, _ in rows]
    for _ in range(rounds):
        grad = [0.0005 * x for x in w]
        for own, (_, pos, t) in zip(active, rows, strict=True):
            miss = (t / (1 + exp(-sum(w[k] for k in own))) - pos) / total
            for k in own:
                grad[k] += miss
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def classifiers(found: DataFrame) -> dict[str, list[float]]:
    """For each kind the weights of its span classifier. Only counts of vote and feature patterns reach the driver.

    Every vote pattern also counts once with its posterior, so that the classifier is defined where no candidate was seen.
    """
    counts = found.groupBy("kind", *VOTES, *FEATURES).count().collect()
    out = {}
    for kind in KINDS:
        own = [r for r in counts if r["kind"] == kind]
        share, rates = em([(tuple(r[v] for v in VOTES), r["count"]) for r in own])
        rows = [(tuple(r[f] for f in FEATURES), posterior(tuple(r[v] for v in VOTES), share, rates) * r["count"], float(r["count"])) for r in own]
        seen = max(1.0, sum(t for _, _, t in rows) / 81)  # as much weight as all that was seen
        rows += [((*sides(v), 1, 0, 0), posterior(v, share, rates) * seen, seen) for v in product((1, 0, -1), repeat=len(VOTES))]
        out[kind] = logistic(rows)
    return out


def spans(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """key, kind, base, start, end of all spans: the base ones, and those that the classifier adds."""
    found = written(labelled(candidates(docs)))
    score = F.lit(-1.0)
    for kind, w in classifiers(found).items():
        score = F.when(F.col("kind") == kind, F.lit(w[0]) + sum(F.lit(x) * F.col(f) for x, f in zip(w[1:], FEATURES, strict=True))).otherwise(score)
    kept = found.where(F.col("strict") | (~F.col("base") & (score > log(keep / (1 - keep)))))
    # By start; an added span must begin after every span before it has ended, and end before the next base span.
    # Two growing frames, each in linear time: what comes before in order, and what comes before in reverse order.
    w = Window.partitionBy("key").orderBy("start", F.desc("strict"), F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("key").orderBy(F.desc("start"), "strict", "end", F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    free = kept.withColumns({"past": F.max("end").over(w), "next": F.min(F.when(F.col("strict"), F.col("start"))).over(back)})
    clear = F.col("strict") | ((F.coalesce("past", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("end") <= F.col("next"), F.lit(True)))
    return free.where(clear).select("key", "kind", F.col("strict").alias("base"), "start", "end")


def _listing(items: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined; items: array of (order, start, end, kind)."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    docs = texts(docs)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct(rank.alias("k"), "start", "end", "kind")
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS]
    lists = [_listing(F.collect_list(F.when(F.col("base"), item))).alias("base_spans"), _listing(F.collect_list(item)).alias("spans")]
    by_key = broadcast_if_small(written(spans(docs).groupBy("key").agg(*counts, *lists)), BROADCAST_ROWS)
    some = docs.where(may_hold(F.col("text"))).select("doc_id", F.md5("text").alias("key")).join(by_key, "key", "left").drop("key")
    out = some.unionByName(docs.where(~may_hold(F.col("text"))).select("doc_id"), allowMissingColumns=True)
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS), F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span of the text replaced by its kind in angle brackets; overlapping spans become one."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    found = spans(docs.select(text.alias("text")))
    w = Window.partitionBy("key").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    item = F.struct("start", F.coalesce(F.max("end").over(w), F.lit(0).cast("long")).alias("past"), "end", "kind")
    key, list_, chars = (free_name(docs, x) for x in ("key", "spans", "chars"))
    by_key = found.select("key", item.alias("x")).groupBy("key").agg(F.array_sort(F.collect_list("x")).alias(list_)).withColumnRenamed("key", key)
    by_key = broadcast_if_small(written(by_key), BROADCAST_ROWS)
    some = docs.where(may_hold(text)).withColumn(key, F.md5(text)).join(by_key, key, "left")
    # The characters as an array, so that each piece costs its own length wherever it stands.
    some = some.withColumn(chars, F.when(F.col(list_).isNotNull(), F.split(text, "")))
    all_, gap = F.col(chars), lambda lo, n: F.array_join(F.slice(chars, lo.cast("int") + 1, n.cast("int")), "")
    pieces = F.transform(list_, lambda x: F.when(x["start"] >= x["past"], F.concat(gap(x["past"], x["start"] - x["past"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise(""))
    last = F.array_max(F.transform(list_, lambda x: x["end"]))
    done = F.concat(F.array_join(pieces, ""), gap(last, F.greatest(F.size(all_) - last, F.lit(0))))
    clean = F.when(F.col(list_).isNull(), F.col(quoted(text_col)).cast("string")).otherwise(done)
    names = [clean.alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns]
    return some.select(*names).unionByName(docs.where(~may_hold(text)).select(*own_columns(docs)))
