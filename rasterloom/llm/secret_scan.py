"""Secret scans (7), with DataFrame functions alone: patterns, then a battery of randomness tests under FDR control.

Base spans are the matches of three patterns. The method adds spans of candidate strings that pass as random: for each
candidate an encoding is inferred (hexadecimal, base 32, alphanumeric, base 64), its symbols are numbered, and three
tests ask whether they could be uniform draws: chi-squared over the alphabet, runs above and below the middle, and
lag-1 serial correlation. Fisher's method joins the three p-values. A false-discovery procedure over all candidates of
the corpus, weighted by length since longer strings give the tests more power, rejects randomness; the rest are
secrets. Its cut is read off a histogram of weighted p-values with a fixed number of bins, so nothing is sorted whole.

Positions are code points, ends exclusive. Null texts are empty and empty texts have no spans. Repeated rows are
scanned one by one, ties (equal spans of two kinds) stay both, an empty table gives an empty result, and columns of
the input other than doc_id and text are left aside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Workspace

# The patterns of the base kinds, in the order in which they are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Least bits that a candidate of its inferred encoding must hold, level of the FDR control, and bins of -log10 p.
LEAST_BITS, LEVEL, BIN, MOST_BIN = 100, 0.05, 0.02, 3000
SPAN = "array<struct<s:int,e:int,v:string>>"
#: Matches that are placed one after the other.
LOT = 256


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Start, end and a group's string of each match, leftmost and non-overlapping.

    Each piece is the text from the last match's end to this one's; the lengths of pieces add up to positions.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))
    parts = F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), F.length(F.regexp_extract(p, pattern, 0)).alias("m"), F.regexp_extract(p, pattern, group).alias("v")))
    empty = F.expr(f"cast(array() as {SPAN})")

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + x["n"]
        return F.struct(at.alias("at"), F.concat(a["out"], F.array(F.struct((at - x["m"]).alias("s"), at.alias("e"), x["v"].alias("v")))).alias("out"))

    def placed(p: Column) -> Column:
        """Lots of matches: the lengths of lots give where each begins, so that no list grows longer than a lot."""
        lots = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / LOT).cast("int")), lambda i: F.slice(p, i * LOT + 1, LOT))
        return let(lots, lambda ls: F.flatten(F.zip_with(ls, begins(ls), lambda lot, at: F.aggregate(lot, F.struct(at.alias("at"), empty.alias("out")), step, lambda a: a["out"]))))

    def begins(lots: Column) -> Column:
        lengths = F.transform(lots, lambda lot: F.aggregate(lot, F.lit(0), lambda a, x: a + x["n"]))
        zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(lengths, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    return let(parts, lambda p: F.when(F.size(p) > 0, placed(p)).otherwise(empty))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal, by a rational approximation of the error function."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-300), poly * F.exp(-x * x)))


def measured(found: DataFrame) -> DataFrame:
    """Adds bits, n and p to candidates (column v): the joint p-value that v, without padding, is uniform."""
    s = F.translate(F.rtrim(F.col("v"), F.lit("=")), "-_", "+/")
    out = found.withColumn("t", s)
    t = F.col("t")
    kind = F.when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(t.rlike("^[A-Z2-7]+$"), "base32").when(t.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")
    out = out.withColumn("kind", kind)
    k = F.col("kind")
    letters = F.when(k == "hex", DIGITS + LOWER[:6]).when(k == "base32", UPPER + DIGITS[2:8]).when(k == "alnum", UPPER + LOWER + DIGITS).otherwise(UPPER + LOWER + DIGITS + "+/")
    out = out.withColumn("letters", letters).withColumn("t", F.when(k == "hex", F.lower("t")).otherwise(F.col("t")))
    out = out.withColumn("b", F.length("letters").cast("double")).withColumn("n", F.length("t").cast("double"))
    # cut into characters once: finding each by its position would walk the string anew
    out = out.withColumn("x", F.expr("transform(filter(split(t, ''), c -> c <> ''), c -> locate(c, letters) - 1)"))
    out = out.withColumn("next", F.expr("slice(x, 2, size(x))")).withColumn("mean", F.expr("aggregate(x, 0D, (a, v) -> a + v) / n"))
    out = out.withColumn("bits", F.col("n") * F.log2("b"))
    squares = F.expr("aggregate(array_distinct(x), 0D, (a, v) -> a + power(size(filter(x, y -> y = v)), 2))")
    free = F.col("b") - 1
    chi = F.greatest(F.lit(0.0), F.col("b") / F.col("n") * squares - F.col("n"))
    z1 = (F.cbrt(chi / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    above = F.expr("cast(size(filter(x, v -> v >= b / 2)) as double)")
    turns = F.expr("1D + size(filter(zip_with(slice(x, 1, size(x) - 1), next, (v, w) -> (v >= b / 2) != (w >= b / 2)), c -> c))")
    out = out.withColumn("z1", z1).withColumn("above", above).withColumn("turns", turns)
    mu = 2 * F.col("above") * (F.col("n") - F.col("above")) / F.col("n") + 1
    var = (mu - 1) * (mu - 2) / (F.col("n") - 1)
    z2 = F.when(var > 0, (F.col("turns") - mu) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(10.0)
    c0 = F.expr("aggregate(x, 0D, (a, v) -> a + power(v - mean, 2))")
    c1 = F.expr("aggregate(zip_with(slice(x, 1, size(x) - 1), next, (v, w) -> (v - mean) * (w - mean)), 0D, (a, v) -> a + v)")
    out = out.withColumn("z2", z2).withColumn("c0", c0).withColumn("c1", c1)
    z3 = F.when(F.col("c0") > 0, (F.col("c1") / F.greatest(F.col("c0"), F.lit(1e-9)) + 1 / F.col("n")) * F.sqrt("n")).otherwise(10.0)
    p1 = F.when(F.col("z1") > 0, tail(F.col("z1")) / 2).otherwise(1 - tail(F.col("z1")) / 2)
    joint = -(F.log(F.greatest(p1, F.lit(1e-300))) + F.log(tail(F.col("z2"))) + F.log(tail(z3)))
    out = out.withColumn("h", joint)
    p = F.exp(-F.col("h")) * (1 + F.col("h") + F.col("h") * F.col("h") / 2)
    return out.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(1e-300), p)))


def random_spans(found: DataFrame, ws: Workspace) -> DataFrame:
    """Candidates (key, s, e, v) that are long enough and whose randomness is not rejected."""
    tested = ws.save(measured(found).filter(F.col("bits") >= LEAST_BITS).select("key", "s", "e", "n", "p"), "tested")
    all_ = tested.agg(F.count("*").alias("m"), F.avg("n").alias("mean")).first()
    if not all_["m"]:
        return tested.select("key", "s", "e")
    bin_ = F.least(F.lit(MOST_BIN), F.greatest(F.lit(0), F.floor(-F.log10(F.col("p") * F.lit(all_["mean"]) / F.col("n")) / BIN))).cast("int")
    binned = tested.withColumn("bin", bin_)
    # at most MOST_BIN + 1 rows
    above = binned.groupBy("bin").agg(F.count("*").alias("c")).withColumn("reach", F.expr("sum(c) over (order by bin desc)"))
    ok = F.pow(F.lit(10.0), -F.col("bin") * BIN) * F.lit(all_["m"]) <= LEVEL * F.col("reach")
    cut = above.filter(ok).agg(F.min("bin").alias("cut")).first()["cut"]
    return binned.filter(F.col("bin") < (cut if cut is not None else MOST_BIN + 1)).select("key", "s", "e")


def labelled_spans(col: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(col, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def may_hold(kind: str) -> Column:
    """False only where a text has no match of this kind."""
    if kind == "assign":
        low = F.lower("text")
        return low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    return F.col("text").contains("AKIA") if kind == "access" else F.col("text").rlike(HEX)


def found_spans(docs: DataFrame, ws: Workspace, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document, in a written table: doc_id, the columns in keep, and spans (s, e, kind), all kinds."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    labelled = []
    for kind, (pattern, group) in zip(KINDS, ((ASSIGN, 2), (ACCESS, 0), (HEX, 0)), strict=True):
        # a cheap test first: most texts hold no keyword, and the search for spans is the slow part
        got = F.when(may_hold(kind), spans(F.col("text"), pattern, group)).otherwise(F.expr(f"cast(array() as {SPAN})"))
        if kind == "assign":
            got = F.filter(got, lambda x: F.length(x["v"]) >= 12)
        labelled.append(labelled_spans(got, kind))
    has = F.col("text").rlike(CANDIDATE)
    cands = F.when(has, spans(F.col("text"), CANDIDATE)).otherwise(F.expr(f"cast(array() as {SPAN})"))
    cands = F.filter(cands, lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]"))
    texts = ["text"] if "text" in keep else []
    first = rows.select("doc_id", *texts, *[f"keep_{c}" for c in keep if c != "text"], F.array_sort(F.concat(*labelled)).alias("base"), cands.alias("cands"))
    first = ws.save(first.withColumn("key", F.monotonically_increasing_id()), "scanned")
    # candidates that touch no base span
    free = F.expr("filter(cands, c -> not exists(base, b -> b.s < c.e and c.s < b.e))")
    loose = first.filter(F.size("cands") > 0).select("key", F.explode(free).alias("c")).select("key", "c.s", "c.e", "c.v")
    kept = random_spans(loose, ws).groupBy("key").agg(F.collect_list(F.struct("s", F.lit(len(KINDS)).alias("k"), "e", F.lit("random").alias("kind"))).alias("more"))
    return first.drop("cands").join(kept, "key", "left").drop("key")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every document."""
    found = found_spans(docs, Workspace(docs.sparkSession))
    line = lambda col: F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    n_random = F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_random")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(every).alias("spans"), n_random)


def redact(docs: DataFrame, mark: str = "[removed]", columns: tuple[str, ...] = ("text", "lang", "source", "n_chars")) -> DataFrame:
    """The documents with every span replaced by a mark; documents without spans stay as they are, nulls included."""
    found = found_spans(docs.withColumn("was_null", F.col("text").isNull()), Workspace(docs.sparkSession), (*columns, "was_null"))
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    fill = F.lit(mark)

    def step(a: Column, x: Column) -> Column:
        s = F.greatest(x["s"], a["at"])
        piece = F.when(x["e"] > a["at"], F.concat(F.substring(F.col("text"), a["at"] + 1, s - a["at"]), fill)).otherwise("")
        return F.struct(F.greatest(x["e"], a["at"]).alias("at"), F.concat(a["out"], F.array(piece)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    joined = F.aggregate(F.col("every"), zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    clean = F.when(F.col("keep_was_null"), F.lit(None).cast("string")).when(F.size("every") > 0, joined).otherwise(F.col("text"))
    out = found.withColumn("every", every).withColumn("clean", clean)
    rest = [F.col(f"keep_{c}").alias(c) for c in columns if c not in ("text", "n_chars")]
    n = [F.when(F.size("every") > 0, F.length("clean").cast("long")).otherwise(F.col("keep_n_chars")).alias("n_chars")] if "n_chars" in columns else []
    return out.select("doc_id", F.col("clean").alias("text"), *rest, *n)
