"""Secrets in texts: fixed patterns, and a battery of randomness tests under false-discovery control.

Fixed patterns give the base spans. What else may be a secret is a run of at least ``MIN_LENGTH`` letters,
digits and ``+/_-`` outside of them. Its encoding is inferred from its characters, and three tests ask
whether its symbols could be drawn at random from that alphabet: chi-squared against equal shares, runs
above and below the alphabet's middle, and the correlation of neighbours. Fisher's method makes one p-value
of the three: high for random text, near 0 for words, names and paths.

Short or oddly spelt words pass such tests too. So every candidate has a decoy of the same length from the
ordinary characters of its own text, read in the candidate's encoding, and both go through the battery. Per
encoding and class of length, counted over all documents, a candidate is reported from that p-value on at
which decoys make up at most ``FALSE_SHARE`` of the candidates.

Built-in functions only. Texts are read once; what is staged is spans and p-values.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.staging import staged

# The patterns, in the order in which spans at one place are listed. Runs are tried from their start only.
BASE = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
}
ASSIGN_LENGTH = 6
KINDS = [*BASE, "random"]

MIN_LENGTH = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}"
#: A candidate that holds one of these overlaps a base span.
_HOLDS_BASE = rf"{BASE['access']}|{BASE['hex']}"

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encoding, the tokens it is inferred for, its alphabet. The first that fits holds; plain numbers have none.
ENCODINGS = [
    ("number", r"^[0-9]+$", None),
    ("hex", r"^(?=.*[0-9])([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef"),
    ("base32", r"^(?=.*[2-7])[A-Z2-7]+$", _UPPER + "234567"),
    ("one_case", r"^([a-z]+|[A-Z]+)$", _LOWER),
    ("letters", r"^[A-Za-z]+$", _UPPER + _LOWER),
    ("alphanumeric", r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", r"^.*$", _UPPER + _LOWER + _DIGITS + "+/"),
]
FOLDED = ("hex", "one_case")  # read in lower case

FALSE_SHARE = 0.1
P_STEPS = 100
#: Lengths are classed by eights, up to LAST_CLASS.
LENGTH_STEP, LAST_CLASS = 8, 16
_BLOCK = 256


# ---- spans ----------------------------------------------------------------------

def _starts(steps: Column) -> Column:
    """Exclusive running sums of an array, block by block, so that long arrays are not copied for each item."""
    empty = F.struct(F.array().cast("array<int>").alias("list"), F.lit(0).alias("total"))

    def running(sums, first):
        return F.aggregate(
            sums, F.struct(empty["list"].alias("list"), first.alias("total")),
            lambda s, x: F.struct(F.concat(s["list"], F.array(s["total"])).alias("list"), (s["total"] + x).alias("total")),
            lambda s: s["list"],
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, running(totals, F.lit(0)), running))


_SPAN = "array<struct<start:int,order:int,end:int,kind:string,text:string>>"


def _found(text: Column, kind: str, pattern: str) -> Column:
    """All matches as (gap before, match, value), null where there is none; the last gap has no match.

    Matches and the gaps between them come from the same pattern, so places add up; nothing is marked in the text.
    """
    value = 2 if kind == "assign" else 0
    return F.when(text.rlike(pattern), F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("value"),
    ))


def _with_spans(df: DataFrame, text: str, kind: str, pattern: str, out: str) -> DataFrame:
    """``df`` with the spans of one kind: code points, end exclusive. ``_found_<out>`` keeps the raw matches."""
    found, steps = f"_found_{out}", f"_steps_{out}"
    df = df.withColumn(found, _found(F.col(text), kind, pattern))
    matched = F.filter(found, lambda x: x["match"].isNotNull())
    df = df.withColumn(steps, F.transform(matched, lambda x: F.struct(
        F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("n"), x["match"].alias("match"), x["value"].alias("value"),
    )))
    df = df.withColumn(f"_at_{out}", F.when(F.size(steps) > 0, _starts(F.transform(steps, lambda x: x["gap"] + x["n"]))))
    spans = F.zip_with(steps, f"_at_{out}", lambda x, at: F.struct(
        (at + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("order"),
        (at + x["gap"] + x["n"]).alias("end"), F.lit(kind).alias("kind"),
        (x["value"] if kind == "assign" else x["match"]).alias("text"),
    ))
    return df.withColumn(out, F.coalesce(spans, F.array()).cast(_SPAN)).drop(steps, f"_at_{out}")


# ---- battery --------------------------------------------------------------------

def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _encoding(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern, alphabet in reversed(ENCODINGS):
        out = F.when(token.rlike(pattern), F.lit(name if alphabet else None).cast("string")).otherwise(out)
    return out


def _alphabet(encoding: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, _, alphabet in ENCODINGS:
        if alphabet:
            out = F.when(encoding == name, F.lit(alphabet)).otherwise(out)
    return out


def _two_sided(z: Column) -> Column:
    """Two-sided normal tail, in the closed form of Bowling et al. (2009), good to 0.0003."""
    z = F.least(F.abs(z), F.lit(8.0))
    return F.lit(2.0) / (F.exp(z * z * z * 0.07056 + z * 1.5976) + 1.0)


def _sum(xs: Column, start=0) -> Column:
    return F.aggregate(xs, F.lit(start), lambda s, x: s + x)


def _neighbours(xs: Column, fn) -> Column:
    return F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), fn)


def _symbols(token: Column, encoding: Column) -> Column:
    """Places of the characters in the alphabet; one outside of it, as in decoys, takes its code modulo the size."""
    folded = F.when(encoding.isin(*FOLDED), F.lower(token)).otherwise(F.translate(token, "-_", "+/"))
    return _let(_alphabet(encoding), lambda a: F.struct(F.length(a).alias("size"), F.transform(
        F.split(folded, ""),
        lambda c: F.coalesce(F.nullif(F.call_function("instr", a, c), F.lit(0)) - 1, F.ascii(c) % F.length(a)),
    ).alias("v")))


def p_random(token: Column, encoding: Column) -> Column:
    """P-value, 0 to 1, of drawing ``token`` (two characters at least) at random from its encoding's alphabet."""
    def measured(x):
        v, size = x["v"], x["size"]
        mean = _sum(v).cast("double") / F.size(v)
        return F.struct(
            size.cast("double").alias("size"), F.size(v).cast("double").alias("n"), v.alias("v"), mean.alias("mean"),
            F.aggregate(
                F.sequence(F.lit(0), size - 1), F.lit(0.0),
                lambda s, k: s + F.pow(F.size(F.filter(v, lambda w: w == k)), F.lit(2)),
            ).alias("squares"),
            F.transform(v, lambda w: (w * 2 >= size).cast("int")).alias("high"),
        )

    def tested(m):
        size, n = m["size"], m["n"]
        return F.struct(
            n.alias("n"), ((m["squares"] * size / n - n - (size - 1)) / F.sqrt((size - 1) * 2 * (n - 1) / n)).alias("chi"),
            _sum(m["high"]).cast("double").alias("above"),
            (_sum(_neighbours(m["high"], lambda a, b: F.abs(a - b))) + 1).cast("double").alias("runs"),
            _sum(_neighbours(m["v"], lambda a, b: (a - m["mean"]) * (b - m["mean"])), 0.0).alias("pairs"),
            _sum(F.transform(m["v"], lambda a: (a - m["mean"]) * (a - m["mean"])), 0.0).alias("spread"),
        )

    def combined(t):
        n, both, worst = t["n"], t["above"] * (t["n"] - t["above"]) * 2, F.lit(8.0)
        runs = (t["runs"] - (both / n + 1)) / F.sqrt(both * (both - n) / (n * n * (n - 1)))
        serial = (t["pairs"] / t["spread"] + F.lit(1.0) / n) * F.sqrt(n)
        return (
            _two_sided(t["chi"]) * _two_sided(F.when(both > n, runs).otherwise(worst))
            * _two_sided(F.when(t["spread"] > 0, serial).otherwise(worst))
        )

    def fisher(p):
        return F.least(F.lit(1.0), p * (F.ln(p) * F.ln(p) / 2 - F.ln(p) + 1))

    chain = _let(_let(_let(_symbols(token, encoding), measured), tested), combined)
    return _let(chain, fisher)


def _step(token: Column, encoding: Column) -> Column:
    return F.least(F.floor(p_random(token, encoding) * P_STEPS).cast("int"), F.lit(P_STEPS - 1))


def _class(length: Column) -> Column:
    return F.least(F.floor(length / LENGTH_STEP).cast("int"), F.lit(LAST_CLASS))


def thresholds(scanned: DataFrame, false_share: float) -> dict[tuple[str, int], int]:
    """(encoding, class of length) -> least p-value step to report, where the decoys allow one.

    At a step, the decoys from there on and one more, made up for texts too short for a decoy, estimate how
    many candidates from there on are ordinary. The driver gets one row for each pair that has a step.
    """
    c = F.explode("candidates").alias("c")
    steps = scanned.select(c).select("c.encoding", "c.class", F.explode(F.array(
        F.struct(F.col("c.step").alias("step"), F.lit(1).alias("real"), F.lit(0).alias("decoy")),
        F.struct(F.col("c.decoy").alias("step"), F.lit(0).alias("real"), F.lit(1).alias("decoy")),
    )).alias("x")).where("x.step is not null")
    cells = steps.groupBy("encoding", "class", "x.step").agg(F.sum("x.real").alias("real"), F.sum("x.decoy").alias("decoy"))
    group = Window.partitionBy("encoding", "class")  # at most P_STEPS rows
    above = group.orderBy(F.desc("step"))
    share = (F.sum("decoy").over(above) + 1) * F.sum("real").over(group) / F.sum("decoy").over(group)
    kept = cells.withColumn("_false", share).withColumn("_real", F.sum("real").over(above))
    rows = kept.where(F.col("_false") <= F.col("_real") * false_share).groupBy("encoding", "class").agg(F.min("step").alias("step"))
    return {(r["encoding"], r["class"]): r["step"] for r in rows.collect()}


def find_secrets(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, n_random, spans), one for each row of ``docs``.

    ``spans`` are (start, end, kind, text) by start, then kind as listed in ``KINDS``: places in code points,
    the end exclusive, of the whole match; ``text`` is the assigned value for ``assign``, else the match.
    ``random`` spans overlap no other. A null text is empty; rows with a null or repeated doc_id have a row
    each, other columns are not read, and an empty table gives no rows.
    """
    given = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    for kind, pattern in BASE.items():
        given = _with_spans(given, "_text", kind, pattern, f"_{kind}")
    given = given.withColumn("_masked", F.coalesce(F.array_join(F.transform("_found__assign", lambda x: F.concat(
        x["gap"], F.when(x["match"].isNull(), F.lit("")).when(F.length(x["value"]) < ASSIGN_LENGTH, x["match"])
        .otherwise(F.repeat(F.lit(" "), F.length(x["match"]))),
    )), ""), F.col("_text")))
    given = given.withColumn("_assign", F.filter("_assign", lambda x: F.length(x["text"]) >= ASSIGN_LENGTH))
    given = _with_spans(given, "_masked", "random", CANDIDATE, "_random")
    given = given.withColumn("_runs", F.filter(
        F.transform("_random", lambda x: F.struct(x.alias("span"), _encoding(x["text"]).alias("encoding"))),
        lambda x: x["encoding"].isNotNull() & ~x["span"]["text"].rlike(_HOLDS_BASE),
    ))
    # the ordinary characters that decoys are taken from
    given = given.withColumn("_plain", F.when(F.size("_runs") > 0, F.regexp_replace(
        F.regexp_replace("_masked", CANDIDATE, " "), "[^A-Za-z0-9]+", ""
    )))

    def decoy(x):
        n, room = F.length(x["span"]["text"]), F.length("_plain")
        return F.when(room >= n, F.substring(F.col("_plain"), F.pmod(x["span"]["start"], room - n + 1) + 1, n))

    def candidate(x):
        n = F.length(x["span"]["text"])
        return F.struct(
            x["span"].alias("span"), x["encoding"].alias("encoding"), _class(n).alias("class"),
            _step(x["span"]["text"], x["encoding"]).alias("step"), _step(decoy(x), x["encoding"]).alias("decoy"),
        )

    scanned = staged(given.select(
        "doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.concat(*(f"_{k}" for k in BASE)).alias("base"), F.transform("_runs", candidate).alias("candidates"),
    ), "secret-spans")
    limits = thresholds(scanned, false_share)
    def reported(x):
        limit = F.lit(P_STEPS)
        for (encoding, size), step in sorted(limits.items()):
            limit = F.when((x["encoding"] == encoding) & (x["class"] == size), step).otherwise(limit)
        return x["step"] >= limit

    added = F.transform(F.filter("candidates", reported), lambda x: x["span"])
    return scanned.withColumn("_added", added).select(
        "doc_id", *(f"n_{k}" for k in BASE), F.size("_added").cast("long").alias("n_random"),
        F.transform(F.array_sort(F.concat("base", "_added")), lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["text"].alias("text"),
        )).alias("spans"),
    )
