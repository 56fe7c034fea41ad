"""Secrets by pattern, and by a battery of randomness tests with false-discovery control. DataFrame functions only.

Patterns give the base spans. Beside them every token of ``LEAST`` or more characters that may be an encoding of random
bytes (hex, base 32, base 64) is tested against "these characters were drawn evenly from the alphabet". An ``=`` is padding at the end of
a token, elsewhere it parts tokens, as in KEY=value or ?sig=value. A token that mixes ``+`` or ``/`` with ``-`` or ``_`` is of no one
encoding; its longest parts of either alphabet are tested instead. The tests are:

- chi-squared over the counts of the alphabet's symbols (cube-root normal form, with the exact mean and variance for the length),
- runs above and below the middle of the alphabet,
- serial correlation of neighbours.

The largest of the three in standard deviations is the token's figure. Tokens of one encoding and one length band form a family, as
short tokens give weaker figures. In each family the Benjamini-Hochberg rule at level ``Q`` says which tokens are *not* random; the
others are secrets. So of the tokens dismissed, at most a share ``Q`` is expected to be random ones lost. The rule needs only the
histogram of figures per family, counted over all documents: a table of bounded size, whatever the corpus.

Defined results: null and empty texts have no spans. Ids and other columns pass as they are; repeated rows are scanned each. Spans
count code points, the end is excluded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import fresh_name, quoted, whole

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")
#: A maximal run of 16 or 18 and more is found as such; a shorter run holds no match.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
LEAST = 20
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_=-]{20})(?:[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?|[A-Za-z0-9+/_-]++=++(?![A-Za-z0-9+/_-]))"
MIXED = r"[+/].*[_-]|[_-].*[+/]"
#: Parts of a mixed token: of the alphabet for file names and URLs, and of the usual one.
PARTS = (r"(?=[A-Za-z0-9_=-]{20})[A-Za-z0-9_-]++=*+", r"(?=[A-Za-z0-9+/=]{20})[A-Za-z0-9+/]++=*+")
#: Encodings: symbols of the alphabet and what a token must look like, in the order in which they are inferred.
ENCODINGS = (
    ("hex", 16, r"^(?=.*[0-9])(?:(?=.*[a-f])[0-9a-f]+|(?=.*[A-F])[0-9A-F]+)$"),
    ("base32", 32, r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$"),
    ("base64", 64, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])(?:[A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*$"),
)
Q = 0.05
TESTS = 3
#: Figures are counted in steps of 1 / STEPS standard deviations, up to MOST steps.
STEPS, MOST = 20, 400
#: Length bands: powers of two, the last one open.
BANDS = 20
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _places(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Spans of a pattern's leftmost matches; with ``least``, of those whose group has so many characters."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if least else found
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), inner.alias("inner"))

    def step(a: Column, r: Column) -> Column:
        start = a["at"] + F.length(r["gap"])
        end = start + F.length(r["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        keep = r["hit"].isNotNull() & (F.length(r["inner"]) >= least)
        return F.struct(F.coalesce(end, a["at"]).alias("at"), F.when(keep, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    return F.aggregate(rows, first, step, lambda a: a["spans"])


def _if(text: Column, gate: str, spans: Column) -> Column:
    return F.when(text.rlike(gate), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> list[Column]:
    """The spans of the three patterns, one array each."""
    return [
        _if(text, r"(?i)password|passwd|secret|token|api_?key", _places(text, ASSIGN, 0, ASSIGN_LEAST)),
        _if(text, LONG_ACCESS, _places(text, LONG_ACCESS, 1)),
        _if(text, LONG_HEX, _places(text, LONG_HEX, 2)),
    ]


def _value(kind: Column, c: Column) -> Column:
    """The value of a character in its alphabet."""
    code = F.ascii(c)
    hexed = F.when(code <= 57, code - 48).otherwise(code.bitwiseOR(F.lit(32)) - 87)
    b32 = F.when(code <= 57, code - 24).otherwise(code - 65)
    b64 = (
        F.when(c.isin("+", "-"), 62).when(c.isin("/", "_"), 63).when(code <= 57, code + 4)
        .when(code >= 97, code - 71).otherwise(code - 65)
    )
    return F.when(kind == 0, hexed).when(kind == 1, b32).otherwise(b64).cast("double")


def _figure(token: Column, kind: Column, n: Column, k: Column) -> Column:
    """The largest of the three statistics in standard deviations. ``n`` characters, ``k`` symbols."""
    body = F.rtrim(F.translate(token, "=", " "))
    x = F.transform(F.split(body, ""), lambda c: _value(kind, c))
    squares = F.aggregate(
        F.sequence(F.lit(0), k.cast("int") - 1), F.lit(0.0), lambda a, s: a + F.pow(F.size(F.filter(x, lambda v: v == s)).cast("double"), F.lit(2.0))
    )
    chi, mean = squares * k / n - n, k - 1
    spread = F.lit(2.0) / 9 * (n - 1) / (n * mean)
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / mean, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    first = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("high"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("lag"))

    def step(a: Column, v: Column) -> Column:
        high = (v >= k / 2).cast("double")
        started = a["last"] >= 0
        turned = started & (high != (a["last"] >= k / 2).cast("double"))
        mid = v - (k - 1) / 2
        before = a["last"] - (k - 1) / 2
        return F.struct(
            v.alias("last"), (a["runs"] + F.when(started & ~turned, 0.0).otherwise(1.0)).alias("runs"), (a["high"] + high).alias("high"),
            (a["s"] + mid).alias("s"), (a["ss"] + mid * mid).alias("ss"), (a["lag"] + F.when(started, mid * before).otherwise(0.0)).alias("lag"),
        )

    def close(a: Column) -> Column:
        up, down = a["high"], n - a["high"]
        runs = 2 * up * down / n + 1
        var = (runs - 1) * (runs - 2) / (n - 1)
        z_runs = F.when((up == 0) | (down == 0) | (var <= 0), F.lit(float(MOST))).otherwise(F.abs(a["runs"] - runs) / F.sqrt(var))
        # Under evenness the values have a known mean and variance, so products of neighbours have variance var * var.
        even = (k * k - 1) / 12
        z_lag = F.abs(a["lag"]) / (F.sqrt(n - 1) * even)
        return F.greatest(z_chi, z_runs, z_lag)

    return F.aggregate(x, first, step, close)


def candidates(text: Column) -> Column:
    """Tokens that may encode random bytes: span, encoding, length band, figure in steps."""
    def held(s: Column) -> Column:
        return F.substring(text, s["start"] + 1, s["end"] - s["start"])

    def parts(s: Column) -> Column:
        token, at = held(s), s["start"]
        inner = F.array_distinct(F.concat(*[_places(token, p, 3) for p in PARTS]))
        moved = F.transform(inner, lambda i: F.struct((at + i["start"]).alias("start"), i["kind"].alias("kind"), (at + i["end"]).alias("end")))
        return F.when(token.rlike(MIXED), moved).otherwise(F.array(s))

    spans = _if(text, TOKEN, F.flatten(F.transform(_places(text, TOKEN, 3), parts)))

    def judge(s: Column) -> Column:
        token = held(s)
        kind = F.coalesce(*[F.when(token.rlike(p), F.lit(i)) for i, (_, _, p) in enumerate(ENCODINGS)])
        n = F.length(F.rtrim(F.translate(token, "=", " "))).cast("double")
        k = F.element_at(F.array(*[F.lit(float(size)) for _, size, _ in ENCODINGS]), kind + 1)
        band = F.least(F.floor(F.log2(n)).cast("int"), F.lit(BANDS))
        steps = F.least(F.floor(F.greatest(_figure(token, kind, n, k), F.lit(0.0)) * STEPS).cast("int"), F.lit(MOST))
        return F.when(
            kind.isNotNull(),
            F.struct(s["start"].alias("start"), s["end"].alias("end"), (kind * (BANDS + 1) + band).alias("family"), steps.alias("steps")),
        )

    return F.filter(F.transform(spans, judge), lambda c: c.isNotNull())


def p_value(steps: int) -> float:
    """Chance that one of the tests reaches a figure of so many steps (two-sided, Bonferroni over the tests)."""
    return min(1.0, TESTS * math.erfc(steps / STEPS / math.sqrt(2)))


def not_random_from(histogram: dict[int, int], q: float = Q) -> int:
    """The Benjamini-Hochberg border of one family: tokens of so many steps or more are not random. ``MOST + 1``: none."""
    total, seen, border = sum(histogram.values()), 0, MOST + 1
    for steps in sorted(histogram, reverse=True):
        seen += histogram[steps]
        if p_value(steps) <= q * seen / total:
            border = steps
    return border


def borders(docs: DataFrame, text: str = "text", q: float = Q) -> dict[int, int]:
    """The border of each family, from the figures of all tokens in all documents. At most 63 families x 401 steps meet here."""
    found = docs.select(F.explode(candidates(whole(F.col(quoted(text))))).alias("c"))
    rows = found.groupBy("c.family", "c.steps").agg(F.count(F.lit(1)).alias("n")).collect()
    families: dict[int, dict[int, int]] = {}
    for family, steps, n in rows:
        families.setdefault(family, {})[steps] = n
    return {f: not_random_from(h, q) for f, h in sorted(families.items())}


def random_spans(found: Column, base: Column, border: dict[int, int]) -> Column:
    """Of the candidates the random ones that no base span holds already."""
    if not border:
        return F.array().cast(SPAN)
    limits = F.create_map(*[F.lit(x) for pair in border.items() for x in pair])
    kept = F.filter(found, lambda c: (c["steps"] < limits[c["family"]]) & ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))


def with_spans(docs: DataFrame, into: str, text: str = "text", q: float = Q) -> DataFrame:
    """``docs`` with a struct ``into``: ``assign``, ``access``, ``hex``, ``base`` and ``spans``, arrays sorted by start and kind."""
    border = borders(docs, text, q)
    t, cells = whole(F.col(quoted(text))), [fresh_name(docs, f"span{k}") for k in range(5)]
    out = docs.withColumns(dict(zip(cells[:3], base_spans(t), strict=True)) | {cells[3]: candidates(t)})
    out = out.withColumn(cells[4], F.array_sort(F.concat(*cells[:3])))
    base = F.col(cells[4])
    spans = F.array_sort(F.concat(base, random_spans(F.col(cells[3]), base, border)))
    every = F.struct(*[F.col(c).alias(k) for c, k in zip(cells[:3], KINDS, strict=False)], base.alias("base"), spans.alias("spans"))
    return out.withColumn(into, every).drop(*cells)


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", q: float = Q) -> DataFrame:
    """Per document the numbers of base spans, their digest, and all spans."""
    own = docs.select(F.col(quoted(key)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    s = with_spans(own, "s", q=q)
    counts = [F.size(f"s.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return s.select("doc_id", *counts, F.sha2(shown(F.col("s.base")), 256).alias("base_sha256"), shown(F.col("s.spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", q: float = Q) -> DataFrame:
    """``docs`` with ``mark`` in place of every span, overlapping spans as one. Null texts stay null."""
    into = fresh_name(docs, "secrets")
    t = F.col(quoted(text))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        gap = F.concat(F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], gap)).otherwise(a["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    spans = F.col(f"{into}.spans")
    clean = F.aggregate(spans, first, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    out = with_spans(docs, into, text, q)
    return out.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(t)).select(*[F.col(quoted(c)) for c in docs.columns])
