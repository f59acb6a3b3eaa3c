"""Secret scans by pattern and by randomness (op 1), with DataFrame functions only.

Base kinds are patterns: an assignment to a telling name, an access key, a hexadecimal run. Spans of kind ``random`` come from a test
battery on runs of 20 or more characters of the base64 alphabets that no base span touches:

- the encoding is the smallest alphabet that holds all characters: digits, hexadecimal, letters of one case, base32,
  letters and digits of one case, base64;
- chi-squared: X2 = k sum(c^2) / n - n over the alphabet's k symbols. Random strings have X2 near k - 1. Ordinary strings
  have more, by n times the excess of the chance that two symbols agree (``EXCESS``), as a noncentral chi-squared variable. Its lower
  tail is the p-value against "ordinary";
- runs above and below the mean symbol, and the serial correlation of neighbours, both of which chance must explain, and X2 must
  not be beyond chance either: counters, alphabets and repeats fail these.

False-discovery control is length-aware: p-values compete only with those of the same encoding and octave of length (Benjamini and
Hochberg at FDR, on p-values rounded up to a tenth of a decade), as short strings hardly can show that they're random.
That table of counts has a fixed size, whatever the corpus; two passes over the texts make the result.

Positions are code points, end exclusive. They come from the lengths of the matches and of what stands between them.

Defined results: null and empty texts have no spans (empty strings, SHA-256 of the empty string); null doc_id stays null; repeated
rows are scanned and counted each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecengine.llm import common

# The patterns and least lengths of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, ACCESS_CHARS = r"AKIA[A-Z0-9]+", 18
HEX, HEX_CHARS = r"[0-9a-f]+", 16
ASSIGN_CHARS = 12
#: A maximal run of 16 or more is a match of HEX that passes; shorter runs never do, so they needn't be located.
LONG_HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
#: Runs that the battery tests; the false-discovery rate; the level at which chance no longer explains a run or a correlation.
TESTED, FDR, CHANCE = r"[A-Za-z0-9+/_-]{20,}={0,2}", 0.01, 0.001
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name, pattern, symbols in order, and the excess of agreement of ordinary strings over chance.
ENCODINGS = (
    ("digits", "[0-9]+", DIGITS, 1.0),
    ("hex", "[0-9a-f]+", DIGITS + LOWER[:6], 1.0),
    ("HEX", "[0-9A-F]+", DIGITS + UPPER[:6], 1.0),
    ("lower", "[a-z]+", LOWER, 0.7),
    ("upper", "[A-Z]+", UPPER, 0.7),
    ("base32", "[A-Z2-7]+", UPPER + DIGITS[2:8], 0.9),
    ("lower36", "[a-z0-9]+", DIGITS + LOWER, 0.9),
    ("upper36", "[A-Z0-9]+", DIGITS + UPPER, 0.9),
    ("base64", "[A-Za-z0-9+/]+", UPPER + LOWER + DIGITS + "+/", 2.0),
    ("base64url", "[A-Za-z0-9_-]+", UPPER + LOWER + DIGITS + "-_", 2.0),
    ("other", ".+", UPPER + LOWER + DIGITS + "+/-_", 2.0),
)
#: The last bin is p = 1e-100: no corpus has so many tokens that stronger evidence could matter, and the table of counts stays bounded.
BINS = 1000


def bound(value: Column, use) -> Column:
    """use(value), where value is computed once however often use or a function inside it refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_blocks(array: Column) -> Column:
    """array, not empty, as an array of about as many blocks as each has elements."""

    def cut(a: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(a))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / step).cast("int")), lambda i: F.slice(a, i * step + 1, step))

    return bound(array, cut)


def before(blocks: Column, width, join) -> Column:
    """For each element of blocks what join makes of 0 and the widths of all elements before it.

    Arrays grow by copies, so elements are run over in blocks, and blocks by their totals: n^1.5 copies for n elements instead of n^2.
    """
    start = lambda first: F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, more: F.struct(more.alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def use(blocks: Column) -> Column:
        total = lambda first, block: F.aggregate(block, first, lambda acc, x: join(acc, width(x)))
        firsts = F.aggregate(blocks, start(F.lit(0)), lambda acc, block: step(acc, total(acc["at"], block)), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, firsts, lambda block, first: F.aggregate(block, start(first), lambda acc, x: step(acc, join(acc["at"], width(x))), lambda acc: acc["out"])))

    return bound(blocks, use)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost matches that don't overlap."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def place(pairs: Column) -> Column:
        starts = before(in_blocks(pairs), lambda x: x["gap"] + F.length(x["m"]), lambda a, b: a + b)
        return F.zip_with(pairs, starts, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("match")))

    pairs = bound(matches, lambda found: F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), F.length(b).alias("gap"))))
    return F.when(text.rlike(pattern), bound(pairs, place)).otherwise(empty)


#: Steps of a binary search, as SQL: arrays have fewer elements than twice the first.
POWERS = f"array({', '.join(str(1 << i) for i in range(26, -1, -1))})"


def touches(spans: Column, t: Column) -> Column:
    """Whether one of spans (ascending, not overlapping) overlaps t."""
    first = F.aggregate(F.expr(POWERS), F.lit(0), lambda at, p: at + F.when(F.get(spans, at + p - 1)["start"] < t["end"], p).otherwise(0))
    return F.coalesce(F.get(spans, first - 1)["end"] > t["start"], F.lit(False))


def of_kind(found: Column, kind: str, keep) -> Column:
    """The matches that keep holds for, as spans."""
    return F.transform(F.filter(found, lambda x: keep(x["match"])), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def normal_tail(z: Column) -> Column:
    """The chance that a standard normal variable is beyond z >= 0, to 1e-7 (a rational approximation of the error function)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def log_lower_tail(z: Column) -> Column:
    """The decimal logarithm of the chance that a standard normal variable is below z, however small: beyond -3 by the continued fraction of the tail."""
    far = F.greatest(-z, F.lit(3.0))
    fraction = far
    for i in range(12, 0, -1):
        fraction = far + i / fraction
    near = F.when(z <= 0, normal_tail(F.least(-z, F.lit(3.0)))).otherwise(1 - normal_tail(F.greatest(z, F.lit(0.0))))
    return F.when(z < -3, -far * far / (2 * math.log(10)) - math.log10(2 * math.pi) / 2 - F.log10(fraction)).otherwise(F.log10(near))


def with_battery(tokens: Column) -> Column:
    """For array<struct<start, end, match>> the same with stratum, bin and plausible: encoding and octave of length, minus ten
    times the decimal logarithm of the p-value against "ordinary", and whether chance explains runs, correlation and X2."""

    def listed(i: int, number: Column) -> Column:
        """What the encoding of that number has at i, from one array of SQL."""
        values = ", ".join(repr(e[i]) if isinstance(e[i], str) else f"{e[i]!r}D" for e in ENCODINGS)
        return F.element_at(F.expr(f"array({values})"), number)

    def read(x: Column) -> Column:
        body, number = F.regexp_replace(x["match"], "=+$", ""), F.lit(len(ENCODINGS))
        for i, e in reversed(list(enumerate(ENCODINGS[:-1], 1))):
            number = F.when(body.rlike(f"^{e[1]}$"), i).otherwise(number)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), body.alias("body"), number.alias("number"))

    def named(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["body"].alias("body"), listed(0, x["number"]).alias("encoding"), listed(2, x["number"]).alias("symbols"), listed(3, x["number"]).alias("excess"))

    # What a function on elements refers to is a field of the step before, so that it is computed once.
    def measure(x: Column) -> Column:
        body, chars = x["body"], F.split(x["body"], "")
        n = F.length(body).cast("double")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow((F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"), F.lit(2.0)))
        values = F.transform(chars, lambda c: F.instr(x["symbols"], c).cast("double"))
        keep = [x[c].alias(c) for c in ("start", "end", "encoding", "excess")]
        return F.struct(*keep, n.alias("n"), F.length(x["symbols"]).cast("double").alias("k"), squares.alias("squares"), values.alias("values"))

    def centre(x: Column) -> Column:
        mean = F.aggregate(x["values"], F.lit(0.0), lambda acc, v: acc + v) / x["n"]
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "encoding", "excess", "n", "k", "squares", "values")], mean.alias("mean"))

    def deviate(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("start", "end", "encoding", "excess", "n", "k", "squares")], F.transform(x["values"], lambda v: v - x["mean"]).alias("d"))

    def correlate(x: Column) -> Column:
        d, n = x["d"], x["n"]
        after = F.slice(d, F.lit(2), F.size(d) - 1)
        before = F.slice(d, F.lit(1), F.size(d) - 1)
        add = lambda acc, v: acc + v
        zero = F.lit(0.0)
        up = F.aggregate(d, zero, lambda acc, v: acc + F.when(v >= 0, 1.0).otherwise(0.0))
        runs = 1 + F.aggregate(F.zip_with(before, after, lambda a, b: F.when((a >= 0) != (b >= 0), 1.0).otherwise(0.0)), zero, add)
        across = F.aggregate(F.zip_with(before, after, lambda a, b: a * b), zero, add)
        own = F.aggregate(F.transform(d, lambda v: v * v), zero, add)
        keep = [x[c].alias(c) for c in ("start", "end", "encoding", "n", "k", "excess", "squares")]
        return F.struct(*keep, (2 * up * (n - up) / n).alias("pairs"), runs.alias("runs"), F.when(own > 0, across / own).otherwise(1.0).alias("r"))

    def judge(x: Column) -> Column:
        n, k, pairs = x["n"], x["k"], x["pairs"]
        x2, extra = k * x["squares"] / n - n, (n - 1) * x["excess"]
        z = (x2 - (k - 1 + extra)) / F.sqrt(2 * (k - 1 + 2 * extra))
        too_much = (x2 - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        spread = pairs * (pairs - 1) / (n - 1)
        runs = F.when(spread > 0, F.abs(x["runs"] - pairs - 1) / F.sqrt(spread)).otherwise(99.0)
        serial = F.abs(x["r"] + 1 / n) * F.sqrt(n)
        by_chance = (2 * normal_tail(runs) >= CHANCE) & (2 * normal_tail(serial) >= CHANCE) & ((too_much <= 0) | (normal_tail(F.greatest(too_much, F.lit(0.0))) >= CHANCE))
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.concat_ws("/", x["encoding"], F.floor(F.log2(n)).cast("string")).alias("stratum"),
            z.alias("z"), by_chance.alias("plausible"),
        )

    def binned(x: Column) -> Column:  # z is a field by now, so that it is computed once
        bin = F.least(F.lit(BINS), F.floor(-10 * log_lower_tail(x["z"]) + 1e-9)).cast("int")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["stratum"].alias("stratum"), bin.alias("bin"), x["plausible"].alias("plausible"))

    for step in (read, named, measure, centre, deviate, correlate, judge, binned):
        tokens = F.transform(tokens, step)
    return tokens


def scanned(docs: DataFrame) -> DataFrame:
    """docs with base (spans) and tested (tokens that no base span touches, with the battery's findings)."""
    text = F.coalesce("text", F.lit(""))
    found = docs.withColumn("_assign", located(text, ASSIGN)).withColumn("_access", located(text, ACCESS)).withColumn("_hex", located(text, LONG_HEX)).withColumn("_token", located(text, TESTED))
    kinds = F.struct(
        of_kind(F.col("_assign"), "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_CHARS).alias("assign"),
        of_kind(F.col("_access"), "access", lambda m: F.length(m) >= ACCESS_CHARS).alias("access"),
        of_kind(F.col("_hex"), "hex", lambda m: F.length(m) >= HEX_CHARS).alias("hex"),
    )
    found = found.withColumn("_kinds", kinds)
    base = F.concat("_kinds.assign", "_kinds.access", "_kinds.hex")
    found = found.withColumn("_base", F.when(F.size(base) > 1, F.array_sort(base)).otherwise(base))
    free = bound(F.col("_kinds"), lambda k: F.filter("_token", lambda t: ~(touches(k["assign"], t) | touches(k["access"], t) | touches(k["hex"], t))))
    return found.withColumn("_free", free).withColumn("_tested", F.when(F.size("_free") > 0, with_battery(F.col("_free"))))


def cuts(docs: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """For each stratum the least bin whose tokens count as random. One row per encoding and octave."""
    return _cuts(scanned(docs.select("text")), fdr)


def _cuts(found: DataFrame, fdr: float) -> dict[str, int]:
    from pyspark.sql import Window

    counts = found.select(F.explode("_tested").alias("t")).groupBy("t.stratum", "t.bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("stratum")
    ranked = counts.select("stratum", "bin", F.sum("n").over(whole).alias("m"), F.sum("n").over(whole.orderBy(F.desc("bin"))).alias("rank"))
    passed = ranked.where(F.col("m") * F.pow(F.lit(10.0), -F.col("bin") / 10) <= fdr * F.col("rank"))
    return {r["stratum"]: r["bin"] for r in passed.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """row (all columns of docs), spans (array<struct<start, kind, end>> of all kinds in order; kind by its place in KINDS) and base (those of the base kinds)."""
    found = scanned(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"))
    least = _cuts(found, fdr)
    spans = F.col("_base")
    if least:
        table = F.create_map(*[x for k, v in sorted(least.items()) for x in (F.lit(k), F.lit(v))])
        random = F.filter("_tested", lambda t: t["plausible"] & (t["bin"] >= F.coalesce(F.try_element_at(table, t["stratum"]), F.lit(BINS + 1))))
        more = F.transform(random, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))
        spans = F.when(F.col("_tested").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", more)))
    return found.select("row", spans.alias("spans"), F.col("_base").alias("base"))


def written_out(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each stretch of overlapping spans (ascending, at least one) replaced by mark."""

    def use(x: Column) -> Column:
        done = before(in_blocks(x["spans"]), lambda s: s["end"], F.greatest)
        return bound(in_blocks(F.zip_with(x["spans"], done, lambda s, at: F.struct(s["start"].alias("start"), s["end"].alias("end"), at.alias("at")))), lambda blocks: pieces(x["text"], blocks))

    def pieces(text: Column, blocks: Column) -> Column:
        """A place in a string is found by counting from its start, so each block takes its part of the text first."""

        def of_block(block: Column) -> Column:
            first = F.get(block, F.lit(0))["at"]
            return bound(F.substring(text, first + 1, F.greatest(F.element_at(block, -1)["start"] - first, F.lit(0))), lambda part: F.array_join(F.transform(block, lambda s: of_span(part, s, first)), ""))

        def of_span(part: Column, s: Column, first: Column) -> Column:
            return F.when(s["start"] >= s["at"], F.concat(F.substring(part, s["at"] - first + 1, s["start"] - s["at"]), F.lit(mark))).otherwise("")

        end = F.aggregate(F.element_at(blocks, -1), F.lit(0), lambda acc, s: F.greatest(acc, s["at"], s["end"]))
        return F.concat(F.array_join(F.transform(blocks, of_block), ""), F.substring(text, end + 1, F.length(text)))

    return bound(F.struct(text.alias("text"), spans.alias("spans")), use)


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs, all columns, with secrets in text replaced; n_chars, if there, is the new length. Texts without secrets stay as they are."""
    found = find_secrets(docs)
    text = F.when(F.size("spans") > 0, redacted(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    found = found.withColumn("new", text)
    length = F.when(F.size("spans") > 0, F.length("new").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    named = {"text": F.col("new"), "n_chars": length}
    return found.select(*[(named[c] if c in named else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("row.doc_id").alias("doc_id"), number("assign"), number("access"), number("hex"), F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"), number("random"))
