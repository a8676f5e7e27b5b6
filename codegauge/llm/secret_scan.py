r"""Secret scans: three base patterns and a randomness battery, with DataFrame functions alone.

Base kinds, leftmost without overlap for each kind; a match that is too short is dropped after matching:
`assign` (a key word, `:` or `=`, and a value of 12 or more characters), `access` (an access-key id of 18 or more),
`hex` (16 or more lower-case hex digits). A span is the whole match, in code points, its end exclusive.

The method adds spans of kind `random`: runs of 20 or more characters of `[A-Za-z0-9+/_-]`, with the padding behind them, in what the base
spans leave of a text; `=` within cuts a run. For each run the encoding is inferred (hex, letters of one case, base32 or base36 of one case,
letters, alphanumeric, base64 or its URL form). A run with any of `+/_-` is judged as it is and in pieces too: those without `-` and `_`,
those without `+` and `/`, and those without all four, of 20 or more characters; their spans may overlap. Four tests ask whether it is
random in that alphabet: chi-squared for uniform use of the characters and of the classes upper case, lower case and others, runs about
the alphabet's middle, and serial correlation. Their p-values are combined by Bonferroni.

What is reported is controlled for false alarms, for each class of lengths by itself, since short runs that are not random look random
more often. The runs with p-values above `SURE` tell how many random ones there are, since those of random runs are spread evenly
(`random_share`); what exceeds that number among the runs above a limit is taken for false alarms. The limit of a class is the lowest from
`LEAST_P` to `SURE` at which they are no more than the share `RATE`, but for an excess of two standard deviations, which chance explains. The
procedure works on counts of p-values in fixed bins (at most 6 x 101 rows, whatever the input).

The cost of one document grows with its length, and with the power 1.5 of its number of matches by copies of small arrays alone: offsets
are running sums in parts of the root of their number, and texts are cut from chunks of fixed length.

Nulls and odd input: a null text counts as empty; a text without findings has zero counts, the digest of the empty string and
empty spans; a null doc_id is passed on; repeated rows are scanned each; ties at one start go by kind in the order above, `random`
last; an empty table gives an empty result; other columns are not read by `scan`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.llm.common import bitmap_of, maybe_in, read_table, written
from codegauge.llm.exact_dedup import in_files, located

#: Kinds in the order of reports, with patterns and the least length of the group that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": (ASSIGN, 2, 12),
    # a run is taken whole by its first match, so the least length can stand in these patterns
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: A run stands between `=`; the last ones of all are its padding.
RUN = r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_-]))?"
#: A text without this holds nothing of the above.
ANY = r"(?i:password|passwd|secret|token|api_?key)|[A-Za-z0-9+/_-]{16}"
#: What is cut out of a run.
PIECES = (r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9]{20,}")
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order of inference, the smallest alphabet first: the pattern of a whole run without its padding, and the alphabet.
ENCODINGS = {
    "hex": ("[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"),
    "lower": ("[a-z]+", LOWER),
    "upper": ("[A-Z]+", UPPER),
    "base32": ("[A-Z2-7]+", UPPER + "234567"),
    "lower base32": ("[a-z2-7]+", LOWER + "234567"),
    "base36": ("[A-Z0-9]+", UPPER + DIGITS),
    "lower base36": ("[a-z0-9]+", LOWER + DIGITS),
    "letters": ("[A-Za-z]+", UPPER + LOWER),
    "alphanumeric": ("[A-Za-z0-9]+", UPPER + LOWER + DIGITS),
    "base64": ("[A-Za-z0-9+/]+", UPPER + LOWER + DIGITS + "+/"),
    "base64url": ("[A-Za-z0-9_-]+", UPPER + LOWER + DIGITS + "-_"),
    "mixed": ("[A-Za-z0-9+/_-]+", UPPER + LOWER + DIGITS + "+/-_"),
}
#: Lengths at which the classes begin.
CLASSES = (20, 24, 32, 48, 64, 128)
#: The share of false alarms, the least p-value that is reported, and that above which all runs are taken for random.
RATE, LEAST_P, SURE = 0.05, 0.01, 0.5
BINS, TESTS = 100, 4
#: Characters of the chunks that texts are cut from.
CHUNK = 1024
MASK = "[SECRET]"

_SPAN = "array<struct<start:int,end:int,value:string,g:int>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(a: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What `add` makes of the numbers up to each one. add: associative, 0 its neutral element. Works in parts of the root of the length."""
    none = F.array().cast("array<int>")

    def along(part: Column, first: Column) -> Column:
        def step(acc, x):
            return F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(add(acc["at"], x))).alias("out"))

        return F.aggregate(part, F.struct(first.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def parts(x):
        n = F.size(x)
        c = F.ceil(F.sqrt(n)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1, c), lambda i: F.slice(x, i + 1, c))

    def joined(p):
        sums = along(F.transform(p, lambda x: F.aggregate(x, F.lit(0), add)), F.lit(0))
        before = F.concat(F.array(F.lit(0)), F.slice(sums, 1, F.size(p) - 1))
        return F.flatten(F.zip_with(p, before, along))

    return _let(a, lambda x: F.when(F.size(x) == 0, none).otherwise(_let(parts(x), joined)))


def _found(text: Column, pattern: str, group: int, least: int) -> Column:
    """start, end and value of each match whose group is long enough."""
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    of_group = every if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    got = F.struct(F.transform(F.split(text, pattern, -1), F.length).alias("gaps"), every.alias("m"), F.transform(of_group, F.length).alias("g"))

    def spans(x):
        moved = F.zip_with(F.slice(x["gaps"], 1, F.size(x["m"])), x["m"], lambda gap, m: gap + F.length(m))  # the last gap follows no match
        rows = F.arrays_zip(_running(moved, lambda a, b: a + b).alias("end"), x["m"].alias("m"), x["g"].alias("g"))
        kept = F.filter(rows, lambda r: r["g"] >= least)
        return F.transform(kept, lambda r: F.struct((r["end"] - F.length(r["m"])).alias("start"), r["end"].alias("end"), r["m"].alias("value"), r["g"].alias("g"))).cast(_SPAN)

    return F.when(text.rlike(pattern), _let(got, spans)).otherwise(F.array().cast(_SPAN))


def _replaced(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """text with fill(characters, whether a span begins behind all before it) in the place of each span. spans: in order of start."""

    def piece(chunks, at, n):
        inner = at % CHUNK
        some = F.slice(chunks, F.floor(at / CHUNK).cast("int") + 1, F.ceil((inner + F.greatest(n, F.lit(0))) / CHUNK).cast("int"))
        return F.when(n <= 0, F.lit("")).otherwise(F.substring(F.array_join(some, ""), inner + 1, n))

    def made(x):
        before = F.concat(F.array(F.lit(0)), F.slice(x["ends"], 1, F.size(x["ends"]) - 1))

        def one(s, at):
            return F.concat(piece(x["chunks"], at, s["start"] - at), fill(F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)), s["start"] >= at))

        last = F.element_at(x["ends"], -1)
        return F.concat(F.array_join(F.zip_with(x["spans"], before, one), ""), piece(x["chunks"], last, x["n"] - last))

    def ends(s):
        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
        return F.struct(chunks.alias("chunks"), s.alias("spans"), _running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)).alias("ends"), F.length(text).alias("n"))

    return F.when(F.size(spans) == 0, text).otherwise(_let(_let(spans, ends), made))


def _tail(z: Column) -> Column:
    """The normal distribution's upper tail, by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # The approximation's coefficients.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _times(text: Column, part: Column | str) -> Column:
    """How often a part, which can't overlap itself, occurs."""
    part = F.lit(part) if isinstance(part, str) else part
    return (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)


def _battery(runs: Column) -> Column:
    """start, end, n, p of each run, and of each piece of a run. Characters are counted in strings; only a chunk's become numbers at once."""

    def pieces(r):
        one = F.struct(*(r[c].alias(c) for c in ("start", "end", "value")))

        def cut(pattern):
            return F.transform(_found(r["value"], pattern, 0, CLASSES[0]), lambda x: F.struct((r["start"] + x["start"]).alias("start"), (r["start"] + x["end"]).alias("end"), x["value"].alias("value")))

        return F.when(r["value"].rlike("[+/_-]"), F.array_distinct(F.concat(F.array(one), *map(cut, PIECES)))).otherwise(F.array(one))

    def coded(r):
        body = F.regexp_replace(r["value"], "=+$", "")
        which = F.lit(None).cast("string")
        for pattern, alphabet in reversed(ENCODINGS.values()):
            which = F.when(body.rlike(f"^({pattern})$"), F.lit(alphabet)).otherwise(which)
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), body.alias("body"), which.alias("alphabet"))

    def folded(r):
        k = F.length(r["alphabet"])
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), F.when(k == 16, F.lower(r["body"])).otherwise(r["body"]).alias("body"), r["alphabet"].alias("alphabet"), k.alias("k"))

    def counted(r):
        body, alphabet, k = r["body"], r["alphabet"], r["k"]
        counts = F.transform(F.sequence(F.lit(1), k), lambda j: _times(body, F.substring(alphabet, j, F.lit(1))))
        half = F.call_function("translate", body, alphabet, F.concat(F.repeat(F.lit("l"), F.floor(k / 2).cast("int")), F.repeat(F.lit("h"), F.ceil(k / 2).cast("int"))))

        def place(c):
            return F.instr(alphabet, c) - 1

        def products(p):  # of neighbours; each chunk ends with the next one's first character
            x = F.transform(F.filter(F.split(F.concat(p["m"], p["next"]), ""), lambda c: c != ""), place)
            return _let(x, lambda y: F.aggregate(F.zip_with(F.slice(y, 1, F.size(y) - 1), F.slice(y, 2, F.size(y)), lambda a, b: a * F.coalesce(b, F.lit(0))), F.lit(0.0), lambda acc, v: acc + v))

        cut = f"(?s).{{1,{CHUNK}}}(?=(.?))"
        chunks = F.arrays_zip(F.regexp_extract_all(body, F.lit(cut), F.lit(0)).alias("m"), F.regexp_extract_all(body, F.lit(cut), F.lit(1)).alias("next"))

        def classes(text):
            return F.array(*((F.length(text) - F.length(F.regexp_replace(text, c, ""))).cast("double") for c in ("[A-Z]+", "[a-z]+", "[^A-Za-z]+")))

        ends = place(F.substring(body, 1, 1)) + place(F.call_function("right", body, F.lit(1)))
        return F.struct(
            r["start"].alias("start"), r["end"].alias("end"), F.length(body).cast("double").alias("n"), k.cast("double").alias("k"), counts.alias("counts"), _let(half, lambda h: F.struct(_times(h, "h").alias("high"), (_times(h, "hl") + _times(h, "lh") + 1).alias("runs"))).alias("half"),
            F.aggregate(F.transform(chunks, products), F.lit(0.0), lambda acc, v: acc + v).alias("products"), ends.alias("ends"), classes(body).alias("used"), classes(alphabet).alias("there"),
        )

    def summed(r):
        at = F.zip_with(r["counts"], F.sequence(F.lit(0), r["k"].cast("int") - 1), lambda c, j: F.struct(c.alias("c"), j.cast("double").alias("j")))

        def total(f):
            return F.aggregate(at, F.lit(0.0), lambda acc, x: acc + f(x))

        expect = F.transform(r["there"], lambda x: x * r["n"] / r["k"])
        by_class = F.aggregate(F.zip_with(r["used"], expect, lambda o, e: F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0)), F.lit(0.0), lambda acc, x: acc + x)
        return F.struct(
            *(r[c].alias(c) for c in ("start", "end", "n", "k", "products", "ends")), r["half"]["high"].alias("high"), r["half"]["runs"].alias("runs"), total(lambda x: x["c"] * x["c"]).alias("square"), total(lambda x: x["c"] * x["j"]).alias("sum"),
            total(lambda x: x["c"] * x["j"] * x["j"]).alias("sum2"), by_class.alias("by_class"), F.size(F.filter(r["there"], lambda x: x > 0)).alias("classes"),
        )

    def judged(r):
        n, df, low = r["n"], r["k"] - 1, r["n"] - r["high"]
        chi = r["square"] * r["k"] / n - n
        z = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))  # Wilson and Hilferty
        of_classes = F.when(r["classes"] == 3, F.exp(-r["by_class"] / 2)).when(r["classes"] == 2, 2 * _tail(F.sqrt(r["by_class"]))).otherwise(1.0)
        expect = 2 * r["high"] * low / n + 1
        spread = F.sqrt(F.greatest((expect - 1) * (expect - 2) / (n - 1), F.lit(1e-9)))
        zr = F.when((r["high"] == 0) | (low == 0), F.sqrt(n)).otherwise((r["runs"] - expect) / spread)
        mean = r["sum"] / n
        variance = r["sum2"] - n * mean * mean
        covariance = r["products"] - mean * (2 * r["sum"] - r["ends"]) + (n - 1) * mean * mean
        zs = (F.when(variance > 1e-9, covariance / variance).otherwise(1.0) + 1 / n) * F.sqrt(n)
        p = F.least(F.lit(1.0), TESTS * F.least(_tail(z), of_classes, 2 * _tail(F.abs(zr)), 2 * _tail(F.abs(zs))))
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), n.cast("int").alias("n"), p.alias("p"))

    out = F.flatten(F.transform(runs, pieces))
    for f in (coded, folded, counted, summed, judged):
        out = F.transform(out, f)
    return out


def _class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(CLASSES[1:], 1):
        out = F.when(n >= least, i).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(p * BINS).cast("int"))


def random_share(p: float) -> float:
    """The share of random runs whose combined p-value is above p < 1."""
    return (1 - p / TESTS) ** TESTS


def limits(rows: DataFrame, rate: float = RATE) -> list[int]:
    """For each class the lowest bin that is reported."""
    each = rows.select(F.explode("runs").alias("r")).select(_class(F.col("r.n")).alias("c"), _bin(F.col("r.p")).alias("b"))
    counts = {(x.c, x.b): x["count"] for x in each.groupBy("c", "b").count().collect()}
    sure = round(SURE * BINS)
    out = []
    for c in range(len(CLASSES)):
        above = [sum(v for (k, at), v in counts.items() if k == c and at >= b) for b in range(BINS + 1)]
        for b in range(round(LEAST_P * BINS), sure + 1):
            real = above[sure] / random_share(SURE) * random_share(b / BINS)
            if above[b] - real <= rate * above[b] + 2 * math.sqrt(above[b]) or b == sure:
                out.append(b)
                break
    return out


def _of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _blank(n: Column, _: Column) -> Column:
    return F.repeat(F.lit(" "), n)


def _parts(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, base spans and judged runs of each row."""

    def both(text):
        base = F.array_sort(F.concat(*(_of_kind(_found(text, *rule), i) for i, rule in enumerate(KINDS.values()))))
        return _let(base, lambda b: F.struct(b.alias("base"), _let(_replaced(text, b, _blank), lambda t: _battery(_found(t, RUN, 0, CLASSES[0]))).alias("runs")))

    none = F.lit(None).cast("struct<base:array<struct<start:int,kind:int,end:int>>,runs:array<struct<start:int,end:int,n:int,p:double>>>")
    got = docs.select(*keys, F.when(F.col("text").rlike(ANY), _let(F.col("text"), both)).otherwise(none).alias("_got"))
    return got.select(*keys, *(F.coalesce(F.col(f"_got.{c}"), F.array()).alias(c) for c in ("base", "runs")))


def scan(docs: DataFrame, *keys: str, rate: float = RATE) -> DataFrame:
    """keys (doc_id by default), and spans: an ordered array of (start, kind, end) of each row; kind by number, 3 being `random`."""
    keys = keys or ("doc_id",)
    rows = written(_parts(docs, *keys), "secret-parts")
    low = limits(rows, rate)

    def random(r):
        least = F.lit(low[0])
        for i, b in enumerate(low[1:], 1):
            least = F.when(_class(r["n"]) == i, b).otherwise(least)
        return _bin(r["p"]) >= least

    more = _of_kind(F.filter("runs", random), len(KINDS))
    return rows.select(*keys, F.array_sort(F.concat("base", more)).alias("spans"), "base")


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, [*KINDS, "random"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """docs with the mask in place of each span; its columns stay as they are, n_chars is made anew if there is one.

    Only rows with spans are moved.
    """
    docs = in_files(docs)
    rows = located(docs, F.struct("*").alias("_all"))
    spans = scan(located(docs, "text"), "_file", "_row").where(F.size("spans") > 0).select("_file", "_row", "spans")
    seen = maybe_in(rows, ["_file", "_row"], bitmap_of(spans, ["_file", "_row"]))
    clean = seen.where(~F.col("_bm_hit")).select("_all.*")
    hit = seen.where("_bm_hit").join(spans, ["_file", "_row"], "left")
    text = F.col("_all.text")
    made = _replaced(text, F.col("spans"), lambda n, begins: F.when(begins, F.lit(mask)).otherwise(""))
    made = F.when(F.col("spans").isNotNull(), made).otherwise(text)
    hit = hit.withColumn("_made", made)

    def column(c: str) -> Column:
        old = F.col(f"_all.`{c}`")
        if c == "text":
            return F.col("_made").alias(c)
        if c == "n_chars":
            return F.when(F.col("spans").isNotNull(), F.length("_made").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return clean.unionByName(hit.select(*map(column, docs.columns)))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(read_table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
