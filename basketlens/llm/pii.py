"""Personal data: strict finders, loose candidate generators, and boosted trees that pick which candidates to redact as well.

Base spans are the leftmost non-overlapping matches of each kind's strict pattern that pass its check. The generators propose
more, overlapping them: obfuscated addresses, numbers with other separators or without a country code. Candidates are labelled
by evidence that their description leaves out: cards by the Luhn sum, addresses of hosts by parts up to 255, mail addresses by a
last part of letters, phones by an international prefix. The description holds bits for the rest of the format and the context,
with obfuscation undone and prefixes cut off, so the trees learn which formats in which surroundings bear out that evidence.
Since the bits are few, all candidates of all documents are learned from as counts per bit pattern. Every fifth of
the documents is scored by boosted trees fitted on the other four; each kind's scores are calibrated by isotonic regression, and
its threshold is the lowest score whose calibrated precision, with one failure more than seen, is at least PRECISION (no
candidate of a kind is taken if there is none). A candidate is added if it touches no base span, reaches its threshold and passes its kind's
check itself; of added ones that overlap, those with a lower score than another go. Base spans always stay.

Only DataFrame functions run on the cluster. Offsets count codepoints and ends are exclusive: they are summed from the lengths
of the matches and of the text between them. The patterns are written so that a scan is linear and does not recurse, however
long a text is. A null text is an empty one and has no spans. Rows that repeat are treated alike; extra columns do no harm.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketlens.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Strict patterns. Possessive quantifiers and the conditions at the start change no match: a run that fails at its first
#: character fails at every later one.
STRICT = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_AT, _DOT = r"(?:\(at\)|\[at\]|\{at\})", r"(?:\(dot\)|\[dot\])"
LOOSE = {
    "email": rf"(?i)[a-z0-9._%+-]{{1,64}}(?:@|\x20?{_AT}\x20?)[a-z0-9-]{{1,63}}(?:(?:\.|\x20?{_DOT}\x20?)[a-z0-9-]{{1,63}}){{1,8}}",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\x20?(?:\[\.\]|\(\.\))\x20?)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:(?:\+|00)[\x20]?)?(?:[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: Without a match of its gate a text has none of the kind. A strict phone may hold groups of one or two digits only.
GATE = {"email": r"@|[aA][tT][)\]}]", "ip": r"[0-9]\x20?[.\[(]", "card": r"[0-9](?:[\x20._-]{0,2}[0-9]){12}", "phone": r"[0-9]{3}"}
STRICT_GATE = GATE | {"phone": r"\+[0-9]"}
CUES = r"(?i)\b(?:e-?mail|mail|phone|tel|call|fax|mobile|ip|host|server|card|credit|visa|account|contact)\b"
CONTEXT = 24
PRECISION, ROUNDS, RATE, FOLDS = 0.98, 40, 0.3, 5


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m, before, after>> of a pattern's matches; before and after are the text up to the next match."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.arrays_zip(between.alias("b"), found.alias("m"), F.slice(between, F.lit(2), F.size(between)).alias("a"))
    empty = F.expr("CAST(array() AS array<struct<start: int, end: int, m: string, before: string, after: string>>)")

    def step(acc, x):
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), F.substring(x["b"], -CONTEXT, CONTEXT).alias("before"), F.substring(x["a"], 1, 1).alias("after"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    spans = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    def step(acc, c):
        d = c.cast("int") * (acc["i"] % 2 + 1)
        return F.struct((acc["i"] + 1).alias("i"), (acc["s"] + F.when(d > 9, d - 9).otherwise(d)).alias("s"))

    digits = F.regexp_extract_all(F.reverse(_digits(m)), F.lit("[0-9]"), F.lit(0))
    return F.aggregate(digits, F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")), step, lambda acc: acc["s"] % 10 == 0)


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>>, by kind and start."""

    def of(kind):
        good = F.filter(F.when(text.rlike(STRICT_GATE[kind]), _matches(text, STRICT[kind])), lambda s: CHECKS[kind](s["m"]))
        return F.coalesce(F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), F.array())

    return F.concat(*map(of, KINDS))


#: What the description of a candidate does not show: obfuscation, and the prefix that makes a phone certain.
MASKS = {
    "email": lambda m: F.regexp_replace(F.regexp_replace(m, rf"(?i)\x20?{_AT}\x20?", "@"), rf"(?i)\x20?{_DOT}\x20?", "."),
    "ip": lambda m: F.regexp_replace(m, r"\x20?(?:\[\.\]|\(\.\))\x20?", "."),
    "card": lambda m: m,
    "phone": lambda m: F.regexp_replace(m, r"^(?:\+|00)\x20?(?:[0-9]{1,3}(?:[\x20.-]|(?=\()))?", ""),
}
#: Checks that an added span passes itself, on the candidate and on its masked form.
ADDED = {
    "email": lambda m, plain: plain.rlike(r"\.[A-Za-z]{2,}$"),
    "ip": lambda m, plain: CHECKS["ip"](plain),
    "card": lambda m, plain: _luhn(m),
    "phone": lambda m, plain: CHECKS["phone"](m),
}


def _class_bits(c: Column) -> list[Column]:
    return [c == "", c.rlike(r"^\s"), c.rlike(r"^\p{L}"), c.rlike("^[0-9]")]


def _bits(kind: str, m: Column, s: Column) -> Column:
    """The format of a masked candidate and its context, a bit for each property."""
    last, n = F.substring(s["before"], -1, 1), F.length(_digits(m))
    properties = [
        *(F.lit(kind == k) for k in KINDS),
        *(n >= k for k in (1, 4, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17)),
        m.rlike(r"[\x20]"), m.rlike("[.]"), m.rlike("-"), m.rlike("_"), m.rlike(r"[(]"), m.rlike(r"^\(?0"), m.rlike("^[3-6]"),
        m.rlike("^[0-9]{4}[^0-9]"), m.rlike("[^0-9][0-9]{4}$"), m.rlike("[^0-9][0-9]{4,6}[^0-9]"), F.length(m) > 30,
        *_class_bits(last), *_class_bits(s["after"]), s["before"].rlike(CUES),
    ]
    return sum((F.when(p, F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j, p in enumerate(properties)), F.lit(0).cast("long"))


def candidate_spans(text: Column) -> Column:
    """array<struct<kind, start, end, bits, ok, sure>> of all generators: `ok` if it may be added, `sure` if its evidence holds."""

    def of(kind):
        found = F.when(text.rlike(GATE[kind]), _matches(text, LOOSE[kind]))

        def span(s):
            plain = MASKS[kind](s["m"])
            ok = ADDED[kind](s["m"], plain)
            sure = ok & s["m"].rlike(r"^(?:\+|00)") if kind == "phone" else ok
            place = [F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")]
            return F.struct(*place, _bits(kind, plain, s).alias("bits"), ok.alias("ok"), sure.alias("sure"))

        return F.coalesce(F.transform(found, span), F.array())

    return F.concat(*map(of, KINDS))


def proposed(docs: DataFrame) -> DataFrame:
    """docs with `__base`, with `__more`, the candidates that may be added and touch no base span, and with `__hit` and `__miss`,
    the bits of all candidates whose evidence holds and of all others."""
    text = F.coalesce(F.col("text"), F.lit(""))
    both = docs.withColumn("__base", base_spans(text)).withColumn("__loose", candidate_spans(text))
    touch = lambda c: F.exists("__base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return (
        both.withColumn("__hit", F.transform(F.filter("__loose", lambda c: c["sure"]), lambda c: c["bits"]))
        .withColumn("__miss", F.transform(F.filter("__loose", lambda c: ~c["sure"]), lambda c: c["bits"]))
        .withColumn("__more", F.transform(F.filter("__loose", lambda c: c["ok"] & ~touch(c)), lambda c: F.struct(c["kind"], c["start"], c["end"], c["bits"])))
        .drop("__loose")
    )


class Trees:
    """Boosted trees of depth two over bits, and a threshold for each kind."""

    def __init__(self, trees: list, start: float, limits: dict[str, float]) -> None:
        self.trees, self.start, self.limits = trees, start, limits

    def score(self, bits: Column) -> Column:
        total = F.lit(self.start)
        is_set = lambda j: bits.bitwiseAND(F.lit(1 << j).cast("long")) != 0
        for a, (b, yy, yn), (c, ny, nn) in self.trees:
            total = total + F.when(is_set(a), F.when(is_set(b), yy).otherwise(yn)).otherwise(F.when(is_set(c), ny).otherwise(nn))
        return total

    def takes(self, candidate: Column) -> Column:
        limit = F.lit(float("inf"))
        for kind, value in self.limits.items():
            limit = F.when(candidate["kind"] == kind, F.lit(value)).otherwise(limit)
        return self.score(candidate["bits"]) >= limit


def _leaf(w, g, h):
    return float(-(w * g).sum() / ((w * h).sum() + 1.0))


def _split(x, w, g, h, rows):
    """The bit that gains most within rows, and the two leaves."""
    G, H = (w * g * rows) @ x, (w * h * rows) @ x
    g_all, h_all = (w * g * rows).sum(), (w * h * rows).sum()
    gain = G**2 / (H + 1) + (g_all - G) ** 2 / (h_all - H + 1)
    j = int(np.argmax(gain))
    return j, float(-G[j] / (H[j] + 1)), float(-(g_all - G[j]) / (h_all - H[j] + 1))


def fit(cells: list) -> Trees:
    """From (bits, fold, positive, negative) counts: trees on all folds, thresholds from every fold's scores by trees that were
    fitted on the others."""
    width = 62
    bits = np.array([c[0] for c in cells], np.int64)
    x = ((bits[:, None] >> np.arange(width)) & 1).astype(float)
    fold, pos, neg = (np.array([c[k] for c in cells], float) for k in (1, 2, 3))
    scores, limits = np.zeros(len(cells)), {}
    for k in range(FOLDS):
        out = fold == k
        scores[out] = _applied(_boosted(x[~out], pos[~out], neg[~out]), x[out])
    for k, kind in enumerate(KINDS):
        mine = x[:, k] == 1
        limit = _limit(scores[mine], pos[mine], neg[mine])
        if limit is not None:
            limits[kind] = limit - 1e-9
    return Trees(_boosted(x, pos, neg), 0.0, limits)


def _boosted(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> list:
    w, y = np.concatenate([pos, neg]), np.concatenate([np.ones(len(pos)), np.zeros(len(neg))])
    xx, score, trees = np.concatenate([x, x]), np.zeros(len(y)), []
    for _ in range(ROUNDS if w.sum() else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        a, _, _ = _split(xx, w, g, h, np.ones(len(y)))
        on = xx[:, a]
        yes, no = _split(xx, w, g, h, on), _split(xx, w, g, h, 1 - on)
        tree = (a, (yes[0], yes[1] * RATE, yes[2] * RATE), (no[0], no[1] * RATE, no[2] * RATE))
        trees.append(tree)
        score += _applied([tree], xx)
    return trees


def _limit(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float | None:
    """The lowest score whose isotonic precision, with a failure more, is at least PRECISION."""
    blocks: list[list[float]] = []  # [lowest score, positive, all], precision falls from block to block
    for score in np.unique(scores[pos + neg > 0])[::-1]:
        same = scores == score
        blocks.append([float(score), pos[same].sum(), pos[same].sum() + neg[same].sum()])
        while len(blocks) > 1 and blocks[-1][1] * blocks[-2][2] >= blocks[-2][1] * blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    good = [low for low, p, n in blocks if p >= PRECISION * (n + 1)]
    return good[-1] if good else None


def _applied(trees: list, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for a, (b, yy, yn), (c, ny, nn) in trees:
        total += np.where(x[:, a] == 1, np.where(x[:, b] == 1, yy, yn), np.where(x[:, c] == 1, ny, nn))
    return total


def learn(found: DataFrame) -> Trees:
    """Trees from the bits of all candidates of all documents; what comes to the driver is one row per bit pattern that occurs,
    a few hundred out of a fixed number of formats and contexts."""
    fold = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))
    marked = lambda side, y: F.transform(side, lambda b: F.struct(b.alias("bits"), F.lit(y).alias("y")))
    # both sides from one scan of the texts
    rows = found.select(fold.alias("fold"), F.inline(F.concat(marked("__hit", 1), marked("__miss", 0))))
    cells = rows.groupBy("bits", "fold").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return fit(sorted(tuple(r) for r in cells.collect()))


def all_spans(trees: Trees) -> Column:
    """array<struct<kind, start, end>> of base and taken candidates, by kind as listed and start."""
    scored = F.transform(F.filter("__more", trees.takes), lambda c: F.struct(c["kind"], c["start"], c["end"], trees.score(c["bits"]).alias("score")))
    beaten = lambda c, all_: F.exists(all_, lambda d: (d["start"] < c["end"]) & (c["start"] < d["end"]) & (d["score"] > c["score"]))
    # bound once by the one-element array, so that candidates are scored once
    best = F.flatten(F.transform(F.array(scored), lambda all_: F.filter(all_, lambda c: ~beaten(c, all_))))
    both = F.array_distinct(F.concat("__base", F.transform(best, lambda c: F.struct(c["kind"], c["start"], c["end"]))))
    return F.concat(*(F.array_sort(of_kind(both, kind)) for kind in KINDS))


def of_kind(spans, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of its texts replaced by its kind in brackets; overlapping spans become one."""
    trees = learn(proposed(docs.select("doc_id", "text")))
    by_start = F.array_sort(F.transform(all_spans(trees), lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def step(acc, s):
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"),
        )

    text = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    found = proposed(docs).withColumn("__spans", by_start)
    return found.withColumn("text", F.when(F.size("__spans") > 0, text).otherwise(F.col("text"))).select(*docs.columns)


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = written(proposed(table(spark, folder, "documents").select("doc_id", "text")).drop("text"))
    trees = learn(found)
    counts = [F.size(of_kind("__base", kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("__base")), 256).alias("base_sha256"), listed(all_spans(trees)).alias("spans"))
