r"""Secret scanning: fixed patterns, then a battery of randomness tests on long tokens. DataFrame functions only.

Base kinds, leftmost and non-overlapping each: `assign` (a password-like name, a separator and a value of 8 or more
characters), `access` (AKIA and capitals or digits, 16 or more) and `hex` (32 or more lower-case hex digits).
Added kind `random`: a maximal run of `[A-Za-z0-9+/_-]` of 16 or more characters (fewer say nothing) with a digit and a letter, whose
characters look drawn at random from the alphabet of its inferred encoding (hex, base32, base36 or base64):

* chi-squared uniformity over groups of the alphabet (as many groups as keep five expected characters in each);
* runs above and below the middle of the alphabet (Wald-Wolfowitz);
* serial correlation of neighbouring characters (lag 1).

Each gives a p-value for "random"; three times the least is the token's p-value. Tokens that Benjamini-Hochberg at level `fdr` finds not to be
random are never reported. What is reported is a discovery that the token is random, so the share of false ones among the reports is
controlled too. Both are done separately for each encoding and length class, as short tokens have little power: tokens above `LAMBDA` are taken for random, and random tokens are as many below it as their share; what lies below it beyond that is not
random. The threshold of a class is the least at which tokens above it hold at most `fdr` of those: a lone token is reported from LAMBDA on,
and where random tokens abound, lower ones are too. Thresholds need only counts of p-values on a grid, so a table
of at most encodings * length classes * GRID rows decides for the whole corpus.

Scale: two map-only passes over the text; what is shuffled is the counts of p-values.

Defined results: null text counts as empty; an empty table gives no rows; texts and tokens of any length are tested whole; where tokens tie at a
threshold they are judged alike; repeated rows and null ids are scanned like any other; other columns are not read, whatever their
names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diskloom.llm.common import materialize

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of one class is maximal, so asking for the length in the pattern drops what would fail and nothing else.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
GRID = 10_000
FDR = 0.05
#: On the grid: tokens with larger p-values are taken for random.
LAMBDA = 2_500


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's variable is not computed again where it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def before(lengths: Column) -> Column:
    """Sums of all earlier elements, by blocks of 64, so that long arrays don't cost their square. Not for empty arrays."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 64).cast("int")), lambda b: F.slice(lengths, b * 64 + 1, 64))
    with_sums = F.transform(blocks, lambda b: F.struct(b.alias("b"), _sum(b).alias("s")))

    def shifted(w: Column) -> Column:
        return F.flatten(F.transform(w, lambda x, i: let(F.aggregate(F.slice(w, F.lit(1), i), F.lit(0), lambda p, q: p + q["s"]), lambda base: F.transform(x["b"], lambda y, j: base + _sum(F.slice(x["b"], F.lit(1), j))))))

    return let(with_sums, shifted)


def spans(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, kind, end, value>> of all matches, in order."""

    def build(parts: Column) -> Column:
        found, gaps = parts["found"], parts["gaps"]
        sizes = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        starts = let(sizes, lambda x: F.zip_with(before(x), gaps, lambda b, g: b + F.length(g)))
        return F.filter(F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end"), m.alias("value"))), lambda x: x["value"].isNotNull())

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(parts, build)).otherwise(F.array().cast("array<struct<start:int,kind:string,end:int,value:string>>"))


def base_spans(text: Column) -> dict[str, Column]:
    assign = F.filter(spans(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8)
    return {"assign": assign, "access": spans(text, ACCESS, "access"), "hex": spans(text, HEX, "hex")}


def encoding_of(token: Column) -> Column:
    """Null if and only if the token has no digit or no letter: words and numbers are not tested.

    Hex and base36 are in one case, with separators - and _ left out where 16 characters remain; all else is base64.
    """
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")

    def known(bare: Column) -> Column:
        found = F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(bare.rlike("^[A-Z2-7]+$"), "base32").when(bare.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36").otherwise("base64")
        return F.when(F.length(bare) >= 16, found).otherwise("base64")

    return F.when(mixed, let(F.translate(token, "-_", ""), known))


def _normal_p(z: Column) -> Column:
    """Two-sided p-value of a normal deviate, to about 2e-4, by a logistic form."""
    a = F.abs(z)
    return 2 / (1 + F.exp(1.5976 * a + 0.07056 * a * a * a))


def battery(token: Column, encoding: Column) -> Column:
    """The token's p-value for randomness: 3 * min(p) of the three tests, at most 1."""
    alphabet = F.element_at(F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair]), encoding)

    def chi_squared(at: Column, n: Column, k: Column, groups: Column) -> Column:
        # a group's share of the alphabet need not be equal: expected counts follow it
        bounds = lambda g: F.floor((g * k + groups - 1) / groups)
        cells = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.struct(F.size(F.filter(at, lambda x: F.floor(x * groups / k) == g)).alias("o"), (n * (bounds(g + 1) - bounds(g)) / k).alias("e")))
        chi = F.aggregate(cells, F.lit(0.0), lambda s, c: s + (c["o"] - c["e"]) * (c["o"] - c["e"]) / c["e"])
        df = groups - 1
        deviate = (F.pow(chi / df, F.lit(1.0 / 3)) - (1 - F.lit(2.0) / (9 * df))) / F.sqrt(F.lit(2.0) / (9 * df))
        return let(deviate, lambda z: 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z)))

    def runs_test(high: Column, n: Column, n1: Column) -> Column:
        n0 = n - n1
        runs = 1 + _sum(F.zip_with(F.slice(high, F.lit(1), n - 1), F.slice(high, F.lit(2), n - 1), lambda x, y: (x != y).cast("int")))
        mean = 1 + 2.0 * n1 * n0 / n
        var = F.greatest(2.0 * n1 * n0 * (2.0 * n1 * n0 - n) / (n * n * (n - 1.0)), F.lit(1e-9))
        return F.when((n1 == 0) | (n0 == 0), F.lit(0.0)).otherwise(let((runs - mean) / F.sqrt(var), _normal_p))

    def serial(at: Column, n: Column, mean: Column) -> Column:
        var = F.aggregate(at, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
        cov = F.aggregate(F.zip_with(F.slice(at, F.lit(1), n - 1), F.slice(at, F.lit(2), n - 1), lambda x, y: (x - mean) * (y - mean)), F.lit(0.0), lambda s, x: s + x)
        return let(var, lambda v: F.when(v <= 0, F.lit(0.0)).otherwise(let((cov / v + 1.0 / n) * F.sqrt(n.cast("double")), _normal_p)))

    def tests(at: Column, k: Column) -> Column:
        n = F.size(at)
        groups = F.least(k, F.greatest(F.lit(2), F.floor(n / 5).cast("int")))
        p_chi = let(groups, lambda g: chi_squared(at, n, k, g))
        p_runs = let(F.transform(at, lambda x: (x * 2 >= k).cast("int")), lambda high: let(_sum(high), lambda n1: runs_test(high, n, n1)))
        p_serial = let(F.aggregate(at, F.lit(0.0), lambda s, x: s + x) / n, lambda mean: serial(at, n, mean))
        return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))

    def positions(a: Column) -> Column:
        mapped = F.translate(token, "-_", "+/")
        folded = F.when(encoding.isin("hex", "base36"), F.lower(mapped)).otherwise(mapped)
        # separators are no characters of the smaller alphabets
        return F.filter(F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.instr(a, c) - 1), lambda x: x >= 0)

    return let(alphabet, lambda a: let(positions(a), lambda at: tests(at, F.length(a))))


def length_class(n: Column) -> Column:
    return F.when(n < 20, 0).when(n < 24, 1).when(n < 32, 2).when(n < 48, 3).when(n < 96, 4).otherwise(5)


def tested(text: Column) -> Column:
    """array<struct<start, kind, end, value, encoding, size, p>> of the tokens that have an encoding; p: 0 to GRID."""
    some = F.transform(spans(text, TOKEN, "random"), lambda s: F.struct(*[s[x].alias(x) for x in ("start", "kind", "end", "value")], encoding_of(s["value"]).alias("encoding"), length_class(F.length(s["value"])).alias("size")))
    some = F.filter(some, lambda s: s["encoding"].isNotNull())
    return F.transform(some, lambda s: F.struct(*[s[x].alias(x) for x in ("start", "kind", "end", "value", "encoding", "size")], F.floor(battery(s["value"], s["encoding"]) * GRID).cast("int").alias("p")))


def thresholds(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> dict[tuple[str, int], int]:
    """For each encoding and length class the grid value above which tokens are reported, or -1 for all.

    Counted over all documents; the table collected has encodings * classes rows.
    """
    from pyspark.sql import Window

    one = docs.where(F.col(text_col).rlike(TOKEN)).select(F.explode(tested(F.col(text_col))).alias("t"))
    # written down, as it is asked for three things and each would scan the texts again
    counts = materialize(one.groupBy("t.encoding", "t.size", "t.p").agg(F.count("*").alias("n")), "secret-counts")
    by = Window.partitionBy("encoding", "size")
    low = F.col("p") <= LAMBDA
    sums = counts.select("encoding", "size", "p", F.sum("n").over(by.orderBy("p")).alias("upto"), F.sum("n").over(by).alias("m"), F.coalesce(F.sum(F.when(low, F.col("n"))).over(by), F.lit(0)).alias("low"))
    # nothing rejected is a candidate too
    none = sums.select("encoding", "size", F.lit(-1).alias("p"), F.lit(0).cast("long").alias("upto"), "m", "low").distinct()
    tried = sums.where(low).unionByName(none)
    # false ones above p: those up to LAMBDA but for the share of the random ones, (m - low) / (1 - LAMBDA), that is due there
    false = (F.col("low") - F.col("upto")) * (GRID - LAMBDA) - (F.col("m") - F.col("low")) * (LAMBDA - 1 - F.col("p"))
    passed = tried.where(false <= F.round((F.col("m") - F.col("upto")) * ((GRID - LAMBDA) * fdr)))
    refused = sums.where((F.col("p") + 1) * F.col("m") <= F.lit(fdr * GRID) * F.col("upto")).groupBy("encoding", "size").agg(F.max("p").alias("refused"))
    least = passed.groupBy("encoding", "size").agg(F.min("p").alias("p")).join(refused, ["encoding", "size"], "left")
    return {(r["encoding"], r["size"]): max(r["p"], -1 if r["refused"] is None else r["refused"]) for r in least.collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(id, assign, access, hex, random): arrays of spans of every row."""
    cut = thresholds(docs, text_col, fdr)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rejected = lambda s: F.lit(False)
    for (encoding, size), p in sorted(cut.items()):
        rejected = (lambda s, f=rejected, e=encoding, z=size, q=p: f(s) | ((s["encoding"] == e) & (s["size"] == z) & (s["p"] <= q)))
    base = base_spans(text)
    kind = "array<struct<start:int,kind:string,end:int,value:string>>"
    extra = F.transform(F.filter(tested(text), lambda s: ~rejected(s)), lambda s: F.struct(*[s[x].alias(x) for x in ("start", "kind", "end", "value")])).cast(kind)
    return docs.select(F.col(id_col).alias(id_col), *[v.alias(k) for k, v in base.items()], F.when(text.rlike(TOKEN), extra).otherwise(F.array().cast(kind)).alias("random"))


def joined(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = {"assign": 0, "access": 1, "hex": 2, "random": 3}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    keyed = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("a"), F.element_at(rank, s["kind"]).alias("b"), s["end"].alias("c"), s["kind"].alias("d"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["d"], s["a"].cast("string"), s["c"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.concat("assign", "access", "hex")
    return found.select(id_col, *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.concat(base, "random")).alias("spans"))
