"""Robust multivariate outliers among documents, in DataFrame operations only.

Each document has statistics of its text, transformed into a vector.  For each language and source
the minimum covariance determinant gives centre and scatter of the `CORE` share of documents that
lie closest together: from two deterministic starts (quartiles; spatial signs) concentration steps
take the documents nearest to the last estimate and estimate again, each group until its determinant no
longer falls; the start with the smaller determinant holds.  The scatter is scaled to the median distance, and one
reweighting step estimates again from all documents within the 97.5 % ellipsoid.  A document beyond
`CUT` in squared Mahalanobis distance is rejected.

`FLOORS` are standard deviations added to the scatter: a statistic that is the same in nearly all
documents, such as no symbols at all, has no spread of its own that deviations could be measured by.

Languages and sources with fewer than `LEAST` documents are pooled by language; those of languages with
fewer are judged by the estimate over all documents of the table.  Null is a language and a
source like others.  Documents that fail the base rules take no part.  Null, empty and blank texts
have 0 everywhere and fail the base rules.  Equal rows count as often as they occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Workspace, text_of

FLOORS = {"length": 0.5, "word_length": 0.1, "symbols": 0.3, "same_lines": 0.1, "same_words": 0.15}
CORE, SETTLED = 0.75, 1e-3
LEAST = 100
#: Chi-square quantiles for five statistics: 50 %, 97.5 % and about 1 - 1e-6.
_MEDIAN, _INNER, CUT = 4.3515, 12.833, 36.0
MIN_WORDS, MAX_REPEATED = 50, 50
_D = len(FLOORS)
_X = [f"x{i}" for i in range(_D)]
#: Bits of a packed window hash that hold its place in the text.
_PLACE = 24


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Evaluate the columns once per row, however often later expressions use them."""
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select("*", made)


def _equals_neighbour(array: str, value) -> Column:
    def test(x, i):
        return (value(F.get(array, i - 1)) == value(x)) | (value(F.get(array, i + 1)) == value(x))

    return F.filter(array, lambda x, i: F.coalesce(test(x, i), F.lit(False)))


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows without their text, with n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words.

    Repeated windows of three words are found without leaving the row: window hashes are packed
    with their place and sorted, those that agree with a neighbour in the leading bits are looked
    at again with all 64 bits, and the stretches that the repeated ones cover are added up."""
    rest = [c for c in docs.columns if c != text]
    whole = text_of(text)
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    df = _once(
        docs.select(
            *rest,
            F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)).alias("_words"),
            (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            lines.alias("_lines"),
        ),
        _w=F.col("_words"),
        _l=F.col("_lines"),
    ).drop("_words", "_lines")
    n = F.size("_w")
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    places = F.sequence(F.lit(0), n - 3)
    packed = F.transform(places, lambda i: window(i).bitwiseAND(F.lit(-1 << _PLACE)).bitwiseOR(i.cast("long")))
    none = F.array().cast("array<bigint>")
    df = _once(
        df.select(
            *rest, "n_symbols", "_w",
            n.cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        ),
        _sorted=F.when((F.col("n_words") >= 4) & (F.col("n_words") < (1 << _PLACE)), F.sort_array(packed)).otherwise(none),
    )
    high = lambda x: F.shiftright(x, _PLACE)
    place = F.transform(
        _equals_neighbour("_sorted", high), lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")
    )
    at = F.when(F.col("n_words") >= (1 << _PLACE), places).when(F.size("_sorted") > 0, place).otherwise(none.cast("array<int>"))
    df = _once(df, _at=at).drop("_sorted")
    full = F.sort_array(F.transform("_at", lambda i: F.struct(window(i).alias("h"), i.alias("i"))))
    df = _once(df, _full=F.when(F.size("_at") > 0, full)).drop("_w", "_at")
    found = F.sort_array(F.transform(_equals_neighbour("_full", lambda x: x["h"]), lambda x: x["i"]))
    df = _once(df, _found=F.when(F.size("_full") > 0, found)).drop("_full")
    covered = F.transform("_found", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_found", k + 1) - x, F.lit(3))))
    total = F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long")
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_found")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.ln(n),
        F.ln(chars / n),
        F.log1p(100.0 * F.col("n_symbols") / chars),
        F.sqrt(10.0 * F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


# --------------------------------------------------------------------- estimates by group


#: The group of all documents.
_ALL = 2


def _groups(rows: DataFrame, work: Workspace) -> DataFrame:
    """(lang, source, group, level): the pool each language and source is judged in; level 2 is all."""
    counts = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < LEAST
    of_language = counts.filter(small).groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("_n_lang"))
    joined = counts.join(of_language, counts["lang"].eqNullSafe(of_language["_lang"]), "left")
    level = F.when(~small, 0).when(F.col("_n_lang") >= LEAST, 1).otherwise(2)
    missing = lambda c: F.struct(F.col(c).isNull(), F.coalesce(c, F.lit("")))
    group = (
        F.when(level == 0, F.xxhash64(F.lit(0), missing("lang"), missing("source")))
        .when(level == 1, F.xxhash64(F.lit(1), missing("lang")))
        .otherwise(F.xxhash64(F.lit(_ALL)))
    )
    return work.keep(joined.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), group.alias("group"), level.alias("_level")))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Centre m and the inverse w of the scatter's Cholesky factor, with its log determinant."""
    pairs = [(i, j) for i in range(_D) for j in range(i + 1)]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *(F.avg(x).alias(f"m{i}") for i, x in enumerate(_X)),
        *(F.avg(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i, j in pairs),
    )
    floors = list(FLOORS.values())
    cov = {
        (i, j): F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (floors[i] ** 2 if i == j else 0.0) for i, j in pairs
    }
    for i, j in pairs:  # row by row: an entry needs those left of it and above
        rest = cov[i, j]
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        entry = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")
        sums = sums.withColumn(f"l{i}{j}", entry)
    for i in range(_D):
        for j in range(i + 1):
            inner = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                inner = inner - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            sums = sums.withColumn(f"w{i}{j}", inner / F.col(f"l{i}{i}"))
    log_det = sum((2 * F.ln(F.col(f"l{i}{i}")) for i in range(_D)), F.lit(0.0))
    return sums.select(*keys, "n", *_M, *_W, log_det.alias("log_det"))


_M = [f"m{i}" for i in range(_D)]
_W = [f"w{i}{j}" for i in range(_D) for j in range(i + 1)]


def distance(scale: Column | float = 1.0) -> Column:
    """Squared Mahalanobis distance of the row's x from the estimate joined to it."""
    total = F.lit(0.0)
    for i in range(_D):
        z = sum((F.col(f"w{i}{j}") * (F.col(_X[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + z * z
    return total / scale


def _core(measured: DataFrame, keys: list[str], work: Workspace) -> DataFrame:
    """The rows nearest to their estimate: the CORE share of each group.  The cuts are written, a row
    per group: the join then knows how few they are, and moves no rows for them."""
    cuts = work.keep(measured.groupBy(*keys).agg(F.percentile_approx("d", CORE, 10_000).alias("cut")))
    return measured.join(cuts, keys).filter(F.col("d") <= F.col("cut"))


def estimates(rows: DataFrame, work: Workspace) -> DataFrame:
    """Per group the reweighted MCD estimate of rows (group, x...): m, w, scale and n."""
    quartiles = rows.groupBy("group").agg(
        *(F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"p{i}") for i, x in enumerate(_X))
    )
    quartiles = work.keep(quartiles)
    floors = list(FLOORS.values())
    z = [
        (F.col(x) - F.col(f"p{i}")[1]) / F.sqrt(((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349) ** 2 + floors[i] ** 2)
        for i, x in enumerate(_X)
    ]
    started = rows.join(quartiles, "group").select("group", *_X, *(c.alias(f"z{i}") for i, c in enumerate(z)))
    norm = F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(_D)), F.lit(0.0)))
    signs = started.select(
        "group", *(F.when(norm > 0, F.col(f"z{i}") / norm).otherwise(0.0).alias(_X[i]) for i in range(_D))
    )
    sign_scatter = work.keep(_moments(signs, ["group"]))
    by_signs = started.select("group", *(F.col(f"z{i}").alias(_X[i]) for i in range(_D)), *(F.col(x).alias(f"_{x}") for x in _X))
    keys = ["group", "start"]
    first = started.select(*(["group", F.lit(0).alias("start"), *_X, norm.alias("d")])).unionByName(
        by_signs.join(sign_scatter, "group").select(
            "group", F.lit(1).alias("start"), *(F.col(f"_{x}").alias(x) for x in _X), distance().alias("d")
        )
    )
    moving, settled = work.keep(_moments(_core(first, keys, work), keys)), None
    while not moving.isEmpty():  # a determinant can't fall for ever: floors bound it
        measured = rows.join(moving.drop("n"), "group").select(*keys, *_X, distance().alias("d"))
        after = _moments(_core(measured, keys, work), keys)
        before = moving.select(*keys, F.col("log_det").alias("_before"))
        after = work.keep(after.join(before, keys).withColumn("_falls", F.col("_before") - F.col("log_det") > SETTLED).drop("_before"))
        still = after.filter(~F.col("_falls")).drop("_falls")
        settled = still if settled is None else settled.unionByName(still)
        moving = after.filter("_falls").drop("_falls")
    estimate = moving if settled is None else settled
    best = estimate.groupBy("group").agg(F.min_by(F.struct(*_M, *_W), F.struct("log_det", "start")).alias("e"))
    best = work.keep(best.select("group", "e.*"))
    near = rows.join(best, "group").withColumn("d", distance())
    scaled = near.groupBy("group").agg(F.percentile_approx("d", 0.5, 10_000).alias("_median"))
    scaled = work.keep(scaled.withColumn("scale", F.greatest(F.lit(1.0), F.col("_median") / _MEDIAN)).drop("_median"))
    inner = near.join(scaled, "group").filter(F.col("d") <= _INNER * F.col("scale")).select("group", *_X)
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"))
    return work.keep(_moments(inner, ["group"]).drop("n").join(sizes, "group"))


def verdicts(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text, lang, source): base statistics, base_failed, distance, kept."""
    work = Workspace(docs.sparkSession)
    measured = base_statistics(docs.select("doc_id", "lang", "source", "text")).withColumn("base_failed", base_failed())
    measured = work.keep(measured.select("*", *(c.alias(x) for c, x in zip(vector(), _X, strict=True))))
    passed = measured.filter(~F.col("base_failed"))
    groups = _groups(passed, work)
    left_over = not groups.filter(F.col("_level") == _ALL).isEmpty()
    own = measured["lang"].eqNullSafe(groups["_lang"]) & measured["source"].eqNullSafe(groups["_source"])
    grouped = work.keep(measured.join(groups, own, "left").drop("_lang", "_source"))
    rows = grouped.filter(~F.col("base_failed")).select("group", "_level", *_X)
    pools = rows.filter(F.col("_level") != _ALL).drop("_level")
    if left_over:
        pools = pools.unionByName(rows.drop("_level").withColumn("group", F.xxhash64(F.lit(_ALL))))
    estimate = estimates(pools, work)
    judged = grouped.join(estimate.select("group", *_M, *_W), "group", "left")
    away = F.when(~F.col("base_failed"), distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("_d") <= CUT, F.lit(True))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*names, away.alias("_d")).select(*names, kept.alias("kept"), F.col("_d").alias("distance"))
