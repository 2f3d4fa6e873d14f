"""Secret scans with a randomness test battery, with DataFrame functions only.

Patterns find assignments, access keys and long hexadecimal runs. What else stands in runs of an
encoding's characters goes through three tests of whether its symbols are drawn at
random: chi-squared uniformity over the inferred alphabet, runs about its middle and
serial correlation. Fisher's method joins the three into one p-value, which is uniform for random symbols
and near zero for text. So in each stratum of encoding and length the flat part of the p-values tells
how many tokens are random, and the cut is the least p-value down to which all but RATE of the
reported tokens are: the false discoveries that are controlled are texts reported as secrets.

The work on a text grows with its length, times the root of its number of spans.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

# The base patterns, in the order that settles ties of start.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters or more; a shorter run cannot hold a longer match
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Encodings in the order in which they are tried: the form of a token, its alphabet (lower case for either case), and the least length at which the battery tells text from random symbols.
ENCODINGS = {
    "decimal": ("^[0-9]+$", "0123456789", 24),
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 24),
    "letters": ("^([A-Z]?[a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz", 48),
    "base32": ("^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567", 24),
    "base36": ("^([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 24),
    "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20),
}
#: Part of the reported tokens that may be text, the part of random tokens that may be lost to the tests, bins of -ln p, and the bins (p over a half, about) that only random tokens fill.
RATE, LOST, BIN, BINS, FLAT = 0.05, 0.01, 0.125, 400, 5

#: Tokens that are as long as their encoding needs.
_WORTH = "^(?!(?:[A-Z]?[a-z]{1,47}|[A-Z]{1,47}|[a-z0-9]{1,23}|[A-Z0-9]{1,23}=*)$)"

_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda t, v: t + v)


def _blocks(array: Column, width: Column) -> Column:
    """Slices of `width`, in order."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(array) / width).cast("int") - 1), lambda k: F.slice(array, k * width + 1, width))


def _root(array: Column) -> Column:
    return F.greatest(F.ceil(F.sqrt(F.size(array).cast("double"))).cast("int"), F.lit(1))


def _stages(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """df with the columns of each step, which may use those of the steps before. Inside one expression Spark would compute what lambdas share at each use, and nested lambdas make planning slow.

    The optimizer puts a column's expression where the column is used once, be it in a lambda; so lambdas take arrays as their arguments, or a column is used twice.
    """
    for step in steps:
        df = df.withColumns(step)
    return df


def pieces(text: Column, pattern: str, group: int | None = None, least: int = 1) -> Column:
    """What a pattern matches, leftmost and non-overlapping, in a text: `found`, the parts `between` (one more), and, with a group, `good`, whether that has `least` characters. Null if nothing matches."""
    made = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.split(text, pattern, -1).alias("between"),
        (F.lit(None).cast("array<boolean>") if group is None else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x) >= least)).alias("good"),
    )
    return F.when(F.rlike(text, F.lit(pattern)), made)


def located(df: DataFrame, names: list[str]) -> DataFrame:
    """df with a column `{name}_t` for each column of pieces: (start, end, token) of the good ones, null for null.

    A start is the sum of all lengths before it, by way of sums of blocks of about the root of their number.
    """

    def each(make: Callable[[Callable[[str], Column]], Column], to: str) -> dict[str, Column]:
        return {f"{n}{to}": make(lambda c, n=n: F.col(f"{n}{c}")) for n in names}

    def spans(c: Callable[[str], Column]) -> Column:
        found, between, good, at = c(".found"), c(".between"), c(".good"), c("_at")
        every = F.transform(found, lambda f, i: F.struct((at[i] + F.length(between[i])).alias("start"), (at[i] + F.length(between[i]) + F.length(f)).alias("end"), f.alias("token"), F.coalesce(F.get(good, i), F.lit(True)).alias("good")))
        return F.filter(every, lambda x: x["good"])

    return _stages(
        df,
        each(lambda c: F.zip_with(F.slice(c(".between"), 1, F.size(c(".found"))), c(".found"), lambda b, f: F.length(b) + F.length(f)), "_n"),
        each(lambda c: _root(c("_n")), "_w"),
        each(lambda c: F.when(c("_n").isNotNull(), _blocks(c("_n"), c("_w"))), "_k"),
        each(lambda c: F.transform(c("_k"), _sum), "_s"),
        each(lambda c: F.transform(c("_s"), lambda _, i: _sum(F.slice(c("_s"), 1, i))), "_h"),
        each(lambda c: F.flatten(F.zip_with(c("_k"), c("_h"), lambda b, h: F.transform(b, lambda _, j: h + _sum(F.slice(b, 1, j))))), "_at"),
        each(spans, "_t"),
    )


def masked(text: Column, cut: Column) -> Column:
    """The text with spaces for the good matches."""
    good = F.coalesce(cut["good"], F.array().cast("array<boolean>"))
    hidden = F.zip_with(cut["found"], good, lambda f, g: F.when(F.coalesce(g, F.lit(True)), F.repeat(F.lit(" "), F.length(f))).otherwise(f))
    joined = F.array_join(F.zip_with(cut["between"], hidden, lambda b, f: F.concat(b, F.coalesce(f, F.lit("")))), "")
    return F.when(cut.isNull(), text).otherwise(joined)


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by the logistic approximation with a cubic term; its error is below 2e-4."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.lit(600.0), 1.5976 * z + 0.070565992 * z * z * z)))


def _encoding(token: Column) -> Column:
    out = F.lit("base64")
    for name, (form, _, _) in reversed([*ENCODINGS.items()][:-1]):
        out = F.when(F.rlike(token, F.lit(form)), name).otherwise(out)
    return out


def _chi(x: Column, a: Column) -> Column:
    """The p-value of the symbols' counts."""
    n = F.size(x).cast("double")
    squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda t, v: t + F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0)))
    return _normal_tail((a / n * squares - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n))


def _runs(up: Column) -> Column:
    """The p-value of the number of runs above and below the middle."""
    n = F.size(up).cast("double")
    n1 = F.size(F.filter(up, lambda v: v)).cast("double")
    changes = F.size(F.filter(F.zip_with(F.slice(up, 1, F.size(up) - 1), F.slice(up, 2, F.size(up) - 1), lambda p, q: p != q), lambda v: v))
    both = 2 * n1 * (n - n1)
    var = both * (both - n) / (n * n * (n - 1))
    return F.when((n1 > 0) & (n1 < n) & (var > 0), 2 * _normal_tail(F.abs(1 + changes - both / n - 1) / F.sqrt(var))).otherwise(F.pow(F.lit(0.5), n - 1))


def _serial(centred: Column) -> Column:
    """The p-value of the correlation of neighbours."""
    n = F.size(centred)
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda t, x: t + x)
    power = add(F.transform(centred, lambda v: v * v))
    lag = add(F.zip_with(F.slice(centred, 1, n - 1), F.slice(centred, 2, n - 1), lambda p, q: p * q))
    return F.when(power > 0, 2 * _normal_tail(F.abs(lag / power) * F.sqrt(n.cast("double")))).otherwise(0.0)


_TESTED = "array<struct<start:int,rank:int,kind:string,end:int,encoding:string,stratum:int,bin:int>>"


def tested(df: DataFrame, tokens: str) -> DataFrame:
    """df with `tested`: encoding, stratum of length (two for each doubling) and bin of -ln p of each of `tokens` (start, end, token). A token without symbols has the last bin."""
    alphabets = F.create_map(*[F.lit(v) for k, (_, a, _) in ENCODINGS.items() for v in (k, a)])
    keep = lambda x, *names: [x[n].alias(n) for n in ("start", "end", *names)]
    symbols = lambda x: F.split(F.regexp_replace(F.translate(F.when(x["e"] == "base64", x["token"]).otherwise(F.lower(x["token"])), "-_", "+/"), "=+$", ""), "")
    half = lambda x: -(F.ln(F.greatest(F.least(x["c"], F.lit(1.0)), F.lit(1e-100))) + F.ln(F.greatest(F.least(x["r"], F.lit(1.0)), F.lit(1e-100))) + F.ln(F.greatest(F.least(x["s"], F.lit(1.0)), F.lit(1e-100))))
    out = _stages(
        df,
        {"_1": F.transform(tokens, lambda x: F.struct(*keep(x, "token"), _encoding(x["token"]).alias("e")))},
        {"_2": F.transform("_1", lambda x: F.struct(*keep(x, "e"), F.length(x["token"]).alias("n"), F.filter(symbols(x), lambda c: c != "").alias("y"), F.element_at(alphabets, x["e"]).alias("a")))},
        {"_3": F.transform("_2", lambda x: F.struct(*keep(x, "e", "n"), F.transform(x["y"], lambda c: F.instr(x["a"], c).cast("double") - 1.0).alias("x"), F.length(x["a"]).cast("double").alias("a")))},
        {"_4": F.transform("_3", lambda x: F.struct(*keep(x, "e", "n", "x", "a"), (F.aggregate(x["x"], F.lit(0.0), lambda t, v: t + v) / F.size(x["x"])).alias("m")))},
        {"_5": F.transform("_4", lambda x: F.struct(*keep(x, "e", "n", "x", "a"), F.transform(x["x"], lambda v: v >= x["a"] / 2).alias("up"), F.transform(x["x"], lambda v: v - x["m"]).alias("centred")))},
        {"_6": F.transform("_5", lambda x: F.struct(*keep(x, "e", "n"), (F.size(x["x"]) > 0).alias("some"), _chi(x["x"], x["a"]).alias("c"), _runs(x["up"]).alias("r"), _serial(x["centred"]).alias("s")))},
        {"_7": F.transform("_6", lambda x: F.struct(*keep(x, "e", "n", "some"), half(x).alias("h")))},  # Fisher's method
        {"_8": F.transform("_7", lambda x: F.struct(*keep(x, "e", "n"), F.when(x["some"], F.exp(-x["h"]) * (1 + x["h"] + x["h"] * x["h"] / 2)).otherwise(0.0).alias("p")))},
    )
    made = F.transform(
        "_8",
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(KINDS.index("random")).alias("rank"),
            F.lit("random").alias("kind"),
            x["end"].alias("end"),
            x["e"].alias("encoding"),
            F.least(F.floor(F.log2(x["n"].cast("double")) * 2), F.lit(40)).cast("int").alias("stratum"),
            F.least(F.floor(-F.ln(F.greatest(x["p"], F.lit(1e-60))) / BIN), F.lit(BINS)).cast("int").alias("bin"),
        ),
    )
    return out.withColumn("tested", F.coalesce(made.cast(_TESTED), F.array().cast(_TESTED)))


def _scanned(rows: DataFrame) -> DataFrame:
    """rows (with `text`) and their base spans and tested candidates, which are looked for outside base spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = rows.columns
    named = reduce(or_, [F.contains(F.lower(text), F.lit(w)) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")])  # a plain search is faster than the pattern, which decides
    cut = _stages(
        rows,
        {"_a": F.when(named, pieces(text, ASSIGN, 2, 6)), "_b": pieces(text, ACCESS), "_h": pieces(text, HEX)},
        {"_m": masked(text, F.col("_a"))},
        {"_o": F.when(F.col("_b").isNotNull() | F.col("_h").isNotNull(), pieces(F.col("_m"), f"{ACCESS}|{HEX}"))},
        {"_m": masked(F.col("_m"), F.col("_o"))},
        {"_c": pieces(F.col("_m"), CANDIDATE)},
        {"_c": F.when(F.col("_c").isNotNull(), F.col("_c").withField("good", F.transform(F.col("_c.found"), lambda x: F.rlike(x, F.lit(_WORTH)))))},
    )
    cut = tested(located(cut.select(*names, "_a", "_b", "_h", "_c"), ["_a", "_b", "_h", "_c"]), "_c_t")
    kind = lambda c, k: F.coalesce(F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), F.lit(k).alias("kind"), x["end"].alias("end"))).cast(_SPAN), F.array().cast(_SPAN))
    base = F.array_sort(F.concat(kind("_a_t", "assign"), kind("_b_t", "access"), kind("_h_t", "hex")))
    return cut.select(*names, base.alias("base"), "tested")


def thresholds(bins: DataFrame, rate: float = RATE, lost: float = LOST) -> dict[tuple[str, int], int]:
    """The last bin that is reported, by encoding and stratum, from counts of bins.

    Random tokens, of which `FLAT` bins hold a known part, fill the bins evenly in p. A bin is in if what lies up to it has at most `rate` more tokens than
    that explains, and its p-value is `lost` or more.
    """
    stratum = Window.partitionBy("encoding", "stratum")
    held = bins.filter(F.exp(-F.col("bin") * BIN) >= lost)
    told = held.withColumn("random", (F.sum(F.when(F.col("bin") < FLAT, F.col("count")).otherwise(0)).over(stratum) + 1) / (1 - F.exp(F.lit(-FLAT * BIN)))).withColumn("all", F.sum("count").over(stratum.orderBy("bin")))
    fit = told.filter(F.col("all") - F.col("random") * (1 - F.exp(-(F.col("bin") + 1) * BIN)) <= rate * F.col("all"))
    return {(r.encoding, r.stratum): r.bin for r in fit.groupBy("encoding", "stratum").agg(F.max("bin").alias("bin")).collect()}  # at most encodings times 41


def _counted(tested: DataFrame) -> DataFrame:
    return tested.filter(F.size("tested") > 0).select(F.explode("tested").alias("x")).groupBy("x.encoding", "x.stratum", "x.bin").count()


def _found(cuts: dict[tuple[str, int], int]) -> Column:
    """Base spans and the candidates within the thresholds, by start, then kind."""
    limits = F.create_map(*[F.lit(v) for (e, s), b in cuts.items() for v in (f"{e}:{s}", b)]) if cuts else F.create_map(F.lit(""), F.lit(-1))
    least = F.create_map(*[F.lit(v) for e, (_, _, n) in ENCODINGS.items() for v in (e, n)])

    def random(x: Column) -> Column:
        limit = F.coalesce(F.try_element_at(limits, F.concat_ws(":", x["encoding"], x["stratum"].cast("string"))), F.lit(-1))
        return (x["end"] - x["start"] >= F.element_at(least, x["encoding"])) & (x["bin"] <= limit)

    more = F.transform(F.filter("tested", random), lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "kind", "end")]))
    return F.array_sort(F.concat("base", more))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, base and found (arrays of (start, rank, kind, end), by start, then kind) of every row. A null text counts as empty; other columns are left out.

    Found are base spans and tokens that pass the battery; the thresholds come from counts over all rows' tokens, one number for each stratum.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = materialize(_scanned(rows).drop("text"))
    return held.select("doc_id", "base", _found(thresholds(_counted(held), rate)).alias("found"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scan(docs, id_col, text_col).select("doc_id", *[number(k) for k in KINDS[:3]], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


#: Behind the end of any text.
_END = 1 << 30


def _replaced(rows: DataFrame, mark: str) -> DataFrame:
    """rows (text, found) with `clean`: the text with `mark` for each run of overlapping spans. Spans are cut in blocks, and a text into the blocks' parts, so that few cuts start from its beginning."""

    def items(p: Column) -> Column:
        """The spans of a part: how far those before reach, and where the next one starts."""
        reach = lambda i: F.greatest(p["before"], F.coalesce(F.array_max(F.transform(F.slice(p["b"], 1, i), lambda s: s["end"])), F.lit(0)))
        return F.transform(p["b"], lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), reach(i).alias("covered"), F.coalesce(F.get(p["b"], i + 1)["start"], p["until"]).alias("next")))

    def text_of(q: Column, s: Column) -> Column:
        after = F.greatest(s["covered"], s["end"])
        return F.concat(F.when(s["start"] >= s["covered"], F.lit(mark)).otherwise(F.lit("")), F.substring(q["body"], after - q["begin"] + 1, F.greatest(s["next"] - after, F.lit(0))))

    some = _stages(
        rows,
        {"_f": F.when(F.size("found") > 0, F.col("found"))},
        {"_w": _root(F.col("_f"))},
        {"_b": F.when(F.col("_f").isNotNull(), _blocks(F.col("_f"), F.col("_w")))},
        {"_r": F.transform("_b", lambda b: F.array_max(F.transform(b, lambda s: s["end"])))},
        {"_e": F.transform("_r", lambda _, i: F.coalesce(F.array_max(F.slice("_r", 1, i)), F.lit(0))), "_u": F.transform("_b", lambda _, i: F.coalesce(F.get("_b", i + 1)[0]["start"], F.lit(_END)))},
        {"_p": F.transform(F.arrays_zip("_b", "_e", "_u"), lambda z: F.struct(z["_b"].alias("b"), z["_e"].alias("before"), z["_u"].alias("until")))},
        {"_q": F.transform("_p", lambda p: F.struct(F.substring(F.col("text"), p["b"][0]["start"] + 1, p["until"] - p["b"][0]["start"]).alias("body"), p["b"][0]["start"].alias("begin"), items(p).alias("items")))},
        {"_t": F.transform("_q", lambda q: F.array_join(F.transform(q["items"], lambda s: text_of(q, s)), ""))},
    )
    whole = F.concat(F.substring(F.col("text"), F.lit(1), F.col("_f")[0]["start"]), F.array_join("_t", ""))
    return some.select(*rows.columns, F.when(F.col("_f").isNull(), F.col("text")).otherwise(whole).alias("clean"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by `mark`, overlapping ones together, and n_chars, if there, set anew. No row is dropped; a null text stays null.

    The rows are scanned twice, for the thresholds and for the texts, and never stored.
    """
    cuts = thresholds(_counted(materialize(_scanned(docs.select(F.col(text_col).alias("text"))).select("tested"))))  # stored, since a filter on it would be pushed down to the texts, with all its expression
    names = docs.columns
    packed = [f"c{i}" for i in range(len(names))]
    rows = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(c).alias(p) for c, p in zip(names, packed, strict=True)]).alias("row"))
    clean = _replaced(_scanned(rows).select("row", "text", _found(cuts).alias("found")), mark).select("row", "clean")
    kinds = {f.name: f.dataType for f in docs.schema}

    def column(i: int, name: str) -> Column:
        if name == text_col:
            return F.col("clean").alias(name)
        if name == "n_chars":
            return F.coalesce(F.length("clean"), F.col(f"row.{packed[i]}")).cast(kinds[name]).alias(name)
        return F.col(f"row.{packed[i]}").alias(name)

    return clean.select(*[column(i, n) for i, n in enumerate(names)])
