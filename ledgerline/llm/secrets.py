r"""Operator 6: secret scans (DataFrame functions only).

Base patterns give the spans of known kinds. A battery of randomness tests adds spans of
kind ``random``: tokens of 20 or more characters of [A-Za-z0-9+/_-], with up to two closing
"=", that overlap no base span. Per token the encoding is inferred (the smallest alphabet that
holds it), and then

* chi-squared of uniformity over the alphabet, the Wald-Wolfowitz runs test (above or below
  the middle of the alphabet) and lag-1 serial correlation ask whether it looks random; the
  least of the three p-values, times three, must be 0.01 or more;
* the same repeat statistic asks how likely ordinary text of this length is to look as
  uniform. Its mean and variance under text depend on the length, so a short token never
  counts as evidence. Benjamini-Hochberg over all tokens of the corpus, on a fixed grid of
  log p-values, holds the share of false discoveries at ``fdr``.

Offsets are code points, ends exclusive. They come from the lengths of the pieces between
matches, summed in blocks of 256, so a text with a million matches stays near linear.

Defined results: null and empty texts have no span; equal rows give equal rows; an empty
table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import stored, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are long enough; the same matches as filtering AKIA[A-Z0-9]+ and [0-9a-f]+ by length.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
#: Fixed values. Alphabet in order, and for ordinary text written in it the chance that two
#: characters agree, and that three do.
ALPHABETS = {
    "decimal": ("0123456789", 0.12, 0.017),
    "hex": ("0123456789abcdef", 0.12, 0.017),
    "upper hex": ("0123456789ABCDEF", 0.12, 0.017),
    "dashed hex": ("0123456789abcdef", 0.12, 0.017),
    "dashed upper hex": ("0123456789ABCDEF", 0.12, 0.017),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066, 0.0054),
    "lower": ("abcdefghijklmnopqrstuvwxyz", 0.066, 0.0054),
    "upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.066, 0.0054),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", 0.064, 0.0051),
    "upper base36": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.064, 0.0051),
    "letters": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.062, 0.0048),
    "alnum": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.062, 0.0048),
    "base64": ("+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", 0.06, 0.0046),
}
INFER = (
    ("decimal", "^[0-9]+$"), ("hex", "^[0-9a-f]+$"), ("upper hex", "^[0-9A-F]+$"), ("dashed hex", "^[0-9a-f]+(-[0-9a-f]+)+$"), ("dashed upper hex", "^[0-9A-F]+(-[0-9A-F]+)+$"), ("lower", "^[a-z]+$"), ("upper", "^[A-Z]+$"), ("base32", "^[A-Z2-7]+$"),
    ("base36", "^[0-9a-z]+$"), ("upper base36", "^[0-9A-Z]+$"), ("letters", "^[A-Za-z]+$"), ("alnum", "^[A-Za-z0-9]+$"),
)
FDR = 0.05
BINS, BIN = 400, 0.05  # grid of -log10 p
MASK = "[SECRET]"
_BLOCK = 256
_CHUNK = 16_384  # characters that a mask is put into at once


def _spans(pieces: Column, matches: Column) -> Column:
    """array<struct<s, e>> of the matches, from what lies between them."""
    lens = F.transform(matches, lambda m, i: F.struct(F.length(F.element_at(pieces, i + 1)).alias("gap"), F.length(m).alias("len")))
    empty = F.expr("cast(array() as array<struct<s:int,e:int>>)")

    def one(lens):
        step = lambda acc, x: F.struct((acc.pos + x.gap + x.len).alias("pos"), F.concat(acc.out, F.array(F.struct((acc.pos + x.gap).alias("s"), (acc.pos + x.gap + x.len).alias("e")))).alias("out"))
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(lens) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK)), F.struct(F.lit(0).alias("pos"), empty.alias("out")), step))
        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<int>)").alias("out")), lambda acc, b: F.struct((acc.pos + b.pos).alias("pos"), F.concat(acc.out, F.array(acc.pos)).alias("out")))["out"]
        shifted = F.zip_with(blocks, starts, lambda b, s: F.transform(b.out, lambda x: F.struct((x.s + s).alias("s"), (x.e + s).alias("e"))))
        return F.flatten(shifted)

    return F.when(F.size(matches) == 0, empty).otherwise(one(lens))


def _q(z: Column) -> Column:
    """Upper tail of the normal distribution (an upper bound within 13 percent, tight in the tail)."""
    a = F.abs(z)
    tail = F.least(F.lit(0.5), F.lit(4 / math.sqrt(2 * math.pi)) * F.exp(-a * a / 2) / (3 * a + F.sqrt(a * a + 8)))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _encoding(token: Column) -> Column:
    out = F.lit("base64")
    for name, pattern in reversed(INFER):
        out = F.when(token.rlike(pattern), name).otherwise(out)
    return out


def _pick(name: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), name)


def battery(token: Column) -> Column:
    """struct<encoding, p_random, p_text> of a token (closing "=" left out)."""
    body = F.rtrim(token, F.lit("="))
    name = _encoding(body)
    # dashes of dashed hex part its groups and are no digits
    body = F.when(name.startswith("dashed"), F.translate(body, "-", "")).otherwise(body)

    def tests(t):
        alphabet = _pick(t.enc, {k: v[0] for k, v in ALPHABETS.items()})
        size = F.length(alphabet).cast("double")
        x = F.transform(F.split(t.body, ""), lambda c: F.instr(alphabet, c).cast("double"))
        return F.transform(F.array(F.struct(x.alias("x"), size.alias("a"), _pick(t.enc, {k: v[1] for k, v in ALPHABETS.items()}).alias("k2"), _pick(t.enc, {k: v[2] for k, v in ALPHABETS.items()}).alias("k3"), t.enc.alias("enc"))), measured)[0]

    def measured(t):
        n = F.size(t.x).cast("double")
        squares = F.aggregate(F.array_distinct(t.x), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(t.x, lambda y: y == c)).cast("double"), F.lit(2.0)))
        # uniformity, by the cube-root normal approximation of chi-squared
        df = t.a - 1
        z_chi = (F.pow((squares * t.a / n - n) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        # runs above and below the middle
        high = F.transform(t.x, lambda y: (y > t.a / 2).cast("int"))
        n1 = F.aggregate(high, F.lit(0), lambda acc, y: acc + y).cast("double")
        runs = 1 + F.aggregate(F.zip_with(F.slice(high, F.lit(2), F.size(high) - 1), F.slice(high, F.lit(1), F.size(high) - 1), lambda p, q: (p != q).cast("int")), F.lit(0), lambda acc, y: acc + y)
        both = 2 * n1 * (n - n1)
        var = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(var > 0, (runs - (both / n + 1)) / F.sqrt(var)).otherwise(F.lit(99.0))
        # lag-1 serial correlation
        mean = F.aggregate(t.x, F.lit(0.0), lambda acc, y: acc + y) / n
        dev = F.transform(t.x, lambda y: y - mean)
        ss = F.aggregate(dev, F.lit(0.0), lambda acc, y: acc + y * y)
        lag = F.aggregate(F.zip_with(F.slice(dev, F.lit(2), F.size(dev) - 1), F.slice(dev, F.lit(1), F.size(dev) - 1), lambda p, q: p * q), F.lit(0.0), lambda acc, y: acc + y)
        z_serial = F.when(ss > 0, (lag / ss + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        p_random = F.least(F.lit(1.0), 3 * F.least(_q(z_chi), 2 * _q(F.abs(z_runs)), 2 * _q(F.abs(z_serial))))
        # the repeat statistic under ordinary text of this length
        pairs = n * (n - 1)
        sd = F.sqrt(2 * pairs * (t.k2 - t.k2 * t.k2) + 4 * pairs * (n - 2) * (t.k3 - t.k2 * t.k2))
        p_text = _q((n + pairs * t.k2 - squares) / sd)
        return F.struct(t["enc"].alias("encoding"), p_random.alias("p_random"), p_text.alias("p_text"))

    return F.transform(F.array(F.struct(body.alias("body"), name.alias("enc"))), tests)[0]


def _found(text: Column, pattern: str, keep=None) -> Column:
    """Spans of a pattern; keep: a function of (matches, index) for those that pass."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = _spans(pieces, matches)
    if keep is not None:
        flags = keep(matches)
        spans = F.transform(F.filter(F.zip_with(spans, flags, lambda s, f: F.struct(s.s.alias("s"), s.e.alias("e"), f.alias("f"))), lambda x: x.f), lambda x: F.struct(x.s.alias("s"), x.e.alias("e")))
    return spans


def scan(docs: DataFrame, *, text_col: str = "text", carry=("doc_id",)) -> DataFrame:
    """Per document the base spans and the measured tokens: columns assign, access, hex, tokens."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(*carry, text.alias("_t"))
    assign = lambda: _found(F.col("_t"), ASSIGN, lambda m: F.transform(F.regexp_extract_all(F.col("_t"), F.lit(ASSIGN), F.lit(2)), lambda g: F.length(g) >= 8))
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    out = out.withColumn("assign", F.when(F.col("_t").rlike(ASSIGN), assign()).otherwise(none))
    out = out.withColumn("access", F.when(F.col("_t").contains("AKIA"), _found(F.col("_t"), ACCESS)).otherwise(none))
    out = out.withColumn("hex", F.when(F.col("_t").rlike(HEX), _found(F.col("_t"), HEX)).otherwise(none))
    tokens = F.regexp_extract_all(F.col("_t"), F.lit(TOKEN), F.lit(0))
    spans = _found(F.col("_t"), TOKEN)
    measured = F.zip_with(spans, F.transform(tokens, battery), lambda s, b: F.struct(s.s.alias("s"), s.e.alias("e"), b.p_random.alias("p_random"), F.least(F.lit(BINS - 1), F.floor(-F.log10(F.greatest(b.p_text, F.lit(1e-300))) / BIN).cast("int")).alias("bin")))
    out = out.withColumn("tokens", F.when(F.col("_t").rlike(TOKEN), measured).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,p_random:double,bin:int>>)")))
    base = F.concat("assign", "access", "hex")
    out = out.withColumn("tokens", F.filter("tokens", lambda t: ~F.exists(base, lambda b: (b.s < t.e) & (t.s < b.e))))
    return out.drop("_t")


def discovery_bin(scanned: DataFrame, fdr: float = FDR) -> int:
    """Least bin of -log10 p_text whose tokens are discoveries (Benjamini-Hochberg on the grid); BINS: none."""
    counts = {r.bin: r.n for r in scanned.select(F.explode("tokens").alias("t")).groupBy(F.col("t.bin").alias("bin")).agg(F.count("*").alias("n")).collect()}  # BINS rows at most
    total, above, least = sum(counts.values()), 0, BINS
    for b in range(BINS - 1, -1, -1):
        above += counts.get(b, 0)
        if above and 10 ** (-b * BIN) * total <= fdr * above:
            least = b
    return least


def _random(least: int):
    return lambda t: (t.bin >= least) & (t.p_random >= 0.01)


def _named(least: int) -> Column:
    """The spans of a scanned row in order."""

    def named(i, kind):
        return lambda x: F.struct(x.s.alias("start"), F.lit(i).alias("kind_order"), x.e.alias("end"), F.lit(kind).alias("kind"))

    return F.array_sort(F.concat(*[F.transform(F.col(k) if k != "random" else F.filter("tokens", _random(least)), named(i, k)) for i, k in enumerate(KINDS)]))


def find_secrets(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", fdr: float = FDR) -> DataFrame:
    """Per document: doc_id and spans, an array of struct<start, kind_order, end, kind> in order."""
    scanned = stored(scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    return scanned.select("doc_id", _named(discovery_bin(scanned, fdr)).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def _cut_out(text: Column, spans: Column, mask: str) -> Column:
    """The text with ``mask`` for every stretch that spans cover; a chunk of the text at a time, so a cut never walks all of it."""
    inner = lambda x: F.exists(spans, lambda y: (y.start <= x.start) & (x.end <= y.end) & ((y.start < x.start) | (x.end < y.end) | (y.kind_order < x.kind_order)))
    alone = F.filter(spans, lambda x: ~inner(x))  # no span lies in another now, so ends rise with starts

    def shown(chunk, first, spans):
        here = F.filter(spans, lambda x: (x.end > first) & (x.start < first + F.length(chunk)))
        ends = F.concat(F.array(F.lit(0)), F.transform(here, lambda x: F.least(x.end - first, F.length(chunk))))

        def piece(x, i):
            before, at = F.get(ends, i), F.greatest(x.start - first, F.lit(0))
            new = (x.start >= first) & ((i == 0) | (x.start >= F.get(ends, i) + first))
            return F.concat(F.substring(chunk, before + 1, F.greatest(F.lit(0), at - before)), F.when(new, F.lit(mask)).otherwise(F.lit("")))

        tail = F.substring(chunk, F.element_at(ends, -1) + 1, F.length(chunk))
        return F.concat(F.array_join(F.transform(here, piece), ""), tail)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    held = F.transform(F.array(F.struct(alone.alias("spans"), chunks.alias("chunks"))), lambda h: F.array_join(F.transform(h.chunks, lambda c, i: shown(c, i * _CHUNK, h.spans)), ""))[0]
    return F.when(F.size(spans) > 0, held).otherwise(text)


def masked(docs: DataFrame, *, text_col: str = "text", fdr: float = FDR, mask: str = MASK) -> DataFrame:
    """docs with every stretch of ``text_col`` that the reported spans cover replaced by ``mask``; a null text stays null,
    the other columns as they are. The texts are scanned once."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    scanned = stored(scan(rows, text_col="_text", carry=("_row",)))
    spans = _named(discovery_bin(scanned, fdr))
    text = F.col("_row").getField(text_col)
    shown = scanned.select("_row", spans.alias("_spans")).withColumn("_text", _cut_out(text, F.col("_spans"), mask))
    return shown.select(*[(F.col("_text") if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x.kind != "random")
    n = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


QUERIES = {"op6_secrets": op6_secrets}
SQL: dict[str, str] = {}
