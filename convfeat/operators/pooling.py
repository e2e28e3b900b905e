"""Pooling of id lists and behaviour sequences into one vector per sample.

Vectors have a declared width, so sums over them are written out per dimension: they stay
primitive, run in generated code and combine before the shuffle.

Packed tokens are rows of whole sequences until the exchange by sample, which only lists of ids
cross. Behind it the rows of single ids are sorted by sample once; vectors of a table that fits a
broadcast are looked up in that order, and the pooling by sample finds its rows in place, so no
vector is shuffled and no sort holds one per token.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convfeat.functions.ids import hash_seq
from convfeat.functions.scoring import sigmoid
from convfeat.operators.lookup import fits_broadcast, keyed_join, lookup, needed_table, zeros
from convfeat.session import stored

#: Most ids with several rows in their table that samples are tested for.
REPEATED = 1000
#: Samples of one task behind the exchange by sample; each holds up to four vectors a domain there.
SAMPLES = 32768


def _sums(prefix: str, vector: str, width: int, weight: str = "") -> list[Column]:
    """Sum of a vector, one column per dimension, each value times ``weight`` if given."""
    factor = f"{weight} * " if weight else ""
    return [F.expr(f"sum({factor}get({vector}, {i})) AS {prefix}{i}") for i in range(width)]


def _holds_any(values: Column) -> Column:
    """Does the list hold an element? The test is a lambda, so what holds it stays out of whole-stage code.

    There, the terms of all dimensions make one method beyond the 8,000 bytes that the JVM compiles,
    and it runs interpreted; outside, Spark splits them into methods that are compiled.
    """
    return F.exists(values, lambda _: F.lit(True))


def _apart(vector: str) -> Column:
    """``vector`` itself, in a projection that stays out of whole-stage code."""
    return F.coalesce(F.when(_holds_any(F.col(vector)), F.col(vector)), F.col(vector)).alias(vector)


def _divided(prefix: str, width: int, by: str) -> Column:
    return F.expr(f"array({', '.join(f'coalesce({prefix}{i}, 0D) / {by}' for i in range(width))})")


def sample_parts(df: DataFrame) -> int:
    """Partitions for an exchange by sample: the session's number, or more for ``SAMPLES`` rows each.

    The exchange moves ids and its readers make vectors of them, so its bytes do not tell the
    memory of a task. Counts the rows of ``df``, which should be stored.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(width, -(-df.count() // SAMPLES))


def embed_mean(
    df: DataFrame, key: str, ids_col: str, table: DataFrame, width: int, out: str = "vec"
) -> DataFrame:
    """(key, mean vector over the non-zero ids of a list); zero vector for an empty list."""
    ids = df.select(key, F.explode_outer(F.filter(ids_col, lambda x: x != 0)).alias("__one"))
    found = lookup(ids, F.col("__one"), table, [key], "__vec")
    counted = F.count(F.when(_holds_any(F.array("__one")), F.col("__one")))
    summed = found.groupBy(key).agg(counted.alias("__n"), *_sums("s", "__vec", width))
    return summed.select(key, _divided("s", width, "greatest(__n, 1)").alias(out))


@dataclass(frozen=True)
class TokenSource:
    """Where the vectors of one side feature come from; see ``route_feature``."""

    route: str
    table: DataFrame | None = None
    buckets: int = 0
    gate_logit: float = 0.0


def _feature_tables(sources: dict[int, TokenSource], lists: Sequence[str], bucket_table: DataFrame | None) -> DataFrame | None:
    """All vector tables in one: (``__fid`` "feature:id", vec), hashed tables already scaled by their gate."""
    tables = []
    for i, (name, source) in enumerate(zip(lists, sources.values())):
        if source.route not in ("table", "hash"):
            continue
        vec = F.col("vec").cast("array<double>")
        if source.route == "hash":
            gate = sigmoid(F.lit(float(source.gate_logit)))
            vec = F.transform(vec, lambda x: x * gate)
        tables.append(source.table.select(F.concat_ws(":", F.lit(i), F.col("id").cast("long")).alias("__fid"), vec.alias("__vec")))
    if bucket_table is not None:
        fid = F.concat_ws(":", F.lit(len(lists) - 1), F.col("id").cast("long"))
        tables.append(bucket_table.select(fid.alias("__fid"), F.col("vec").cast("array<double>").alias("__vec")))
    if not tables:
        return None
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def sequence_tokens(
    df: DataFrame,
    key: str,
    domain: str,
    sources: dict[int, TokenSource],
    part_width: int,
    bucket_table: DataFrame | None = None,
    carry: Sequence[str] = (),
    table: DataFrame | None = None,
) -> DataFrame:
    """(key, carry, pos, token): the side vectors of each valid position side by side.

    ``df`` is converted. A time-gap vector comes last when ``bucket_table`` is given. A sample
    without events keeps one row with null ``pos`` and ``token``. ``table`` may give the rows of
    ``_feature_tables`` that the samples need.

    All side features share one lookup: every (position, feature) becomes a row with the key
    "feature:id" of its table row, one sketch finds the frequent keys of all features, one
    salted join fetches the vectors, and one grouping by (key, pos) puts them back side by side
    in feature order. The number of passes does not grow with the number of features.
    """
    lists = [f"{domain}_{fid}" for fid in sources]
    if bucket_table is not None:
        lists.append(f"{domain}_time_bucket")
    valid = df.select(key, *carry, *[F.slice(c, F.lit(1), F.col(f"{domain}_len")).alias(c) for c in lists])
    rows = valid.select(key, *carry, F.posexplode_outer(F.arrays_zip(*lists)).alias("pos", "__event"))
    routes = [s.route for s in sources.values()] + (["table"] if bucket_table is not None else [])
    hashed = {i: s.buckets for i, s in enumerate(sources.values()) if s.route == "hash"}
    keys = []
    for i, name in enumerate(lists):
        raw = F.col(f"__event.{name}")
        looked = F.expr(hash_seq(f"__event.`{name}`", hashed[i])) if i in hashed else raw
        fid = F.when(looked > 0, F.concat_ws(":", F.lit(i), looked.cast("long"))) if routes[i] in ("table", "hash") else F.lit(None).cast("string")
        keys.append(F.struct(F.lit(i).alias("f"), fid.alias("__fid")))
    first = [F.when(F.col("__part.f") == 0, F.col(c)).alias(c) for c in carry]
    parts = rows.select(key, "pos", *[F.col(c).alias(c) for c in carry], F.explode(F.array(*keys)).alias("__part"))
    parts = parts.select(key, "pos", *first, F.col("__part.f").alias("__f"), F.col("__part.__fid").alias("__fid"))
    table = _feature_tables(sources, lists, bucket_table) if table is None else table
    if table is None:
        found = parts.withColumn("__vec", F.lit(None).cast("array<double>"))
    else:
        found = keyed_join(parts, table, "__fid", [key, "pos", "__f"])
    found = found.withColumn("__vec", F.coalesce("__vec", zeros(part_width)))
    grouped = found.groupBy(key, "pos").agg(
        *[F.max(c).alias(c) for c in carry], F.sort_array(F.collect_list(F.struct("__f", "__vec"))).alias("__parts")
    )
    token = F.when(F.col("pos").isNotNull(), F.flatten(F.transform("__parts", lambda p: p["__vec"])))
    return grouped.select(key, *carry, "pos", token.alias("token"))


@dataclass(frozen=True)
class PackedTokens:
    """``sequence_tokens`` in two parts, both token rows.

    ``rows`` are of keys of one sample and lie partitioned and sorted by key; ``others`` are of keys
    that several samples share and of samples with an id that has several rows in its table.
    ``parts`` is the number of partitions of ``rows`` if it was given.
    """

    rows: DataFrame
    others: DataFrame
    parts: int | None = None


@dataclass(frozen=True)
class LateVector:
    """The vector column ``name`` of a sample, looked up behind the exchange by sample.

    Only ``columns`` cross it; ``add`` replaces them by the vector, one row by one, and leaves the rows in place.
    """

    name: str
    columns: Sequence[str]
    add: Callable[[DataFrame], DataFrame]


def _fids(feature: int, ids: Column) -> Column:
    return F.transform(F.filter(ids, lambda x: x > 0), lambda x: F.concat_ws(":", F.lit(feature), x))


def packed_tokens(
    df: DataFrame,
    key: str,
    domain: str,
    sources: dict[int, TokenSource],
    part_width: int,
    bucket_table: DataFrame | None = None,
    carry: Sequence[str] = (),
    parts: int | None = None,
    late: LateVector | None = None,
) -> PackedTokens:
    """``sequence_tokens`` in two parts; all token rows are ``others`` when the tables fit no broadcast.

    ``parts`` is the number of partitions of the exchange by ``key``; without it Spark chooses.
    The rows carry ``late`` too, if given.
    """
    add, full = (late.add, [*carry, late.name]) if late else (lambda given: given, carry)
    carry = [*carry, *late.columns] if late else carry
    lists = [f"{domain}_{fid}" for fid in sources] + ([f"{domain}_time_bucket"] if bucket_table is not None else [])
    read = df.select(key, *carry, *lists, f"{domain}_len")
    table = _feature_tables(sources, lists, bucket_table)
    hashed = {i: s.buckets for i, s in enumerate(sources.values()) if s.route == "hash"}
    looked = [i for i, s in enumerate(sources.values()) if s.route in ("table", "hash")] + ([len(lists) - 1] if bucket_table is not None else [])
    sliced = [F.slice(c, F.lit(1), F.col(f"{domain}_len")) for c in lists]
    ids = [F.expr(f"transform(slice(`{c}`, 1, {domain}_len), x -> {hash_seq('x', hashed[i])})") if i in hashed else sliced[i] for i, c in enumerate(lists)]
    ids = [x if i in looked else F.transform(x, lambda _: F.lit(0)) for i, x in enumerate(ids)]
    ids = [F.transform(x, lambda v: v.cast("long")) for x in ids]
    fids = [_fids(i, ids[i]) for i in looked]
    unpacked = lambda given: sequence_tokens(add(given), key, domain, sources, part_width, bucket_table, full, table)
    if table is not None:
        if not fits_broadcast(table):
            read = stored(read, "sequences")
        table = needed_table(table, "__fid", read.select(F.explode(F.concat(*fids)).alias("__fid")))
    twice = [] if table is None else table.groupBy("__fid").count().where("count > 1").limit(REPEATED + 1).collect()
    if table is None or len(twice) > REPEATED:
        empty = add(read.limit(0)).select(key, *full, F.lit(0).alias("pos"), F.array().cast("array<double>").alias("token"))
        return PackedTokens(empty, unpacked(read), parts)
    repeated = [r["__fid"] for r in twice]
    dealt = read.repartition(parts, key) if parts else read.repartition(key)
    by_key = Window.partitionBy(key)
    names = [f"f{i}" for i in range(len(lists))]
    rows = dealt.select(key, *carry, *[x.alias(n) for x, n in zip(ids, names)])
    rows = rows.select(key, *carry, F.posexplode_outer(F.arrays_zip(*names)).alias("pos", "__event"))
    rows = rows.select(key, *carry, "pos", *[F.col(f"__event.{n}").alias(n) for n in names])
    rows = rows.withColumn("__samples", F.count(F.when(F.coalesce("pos", F.lit(0)) == 0, 1)).over(by_key))
    if repeated:
        of = {i: [int(f.split(":")[1]) for f in repeated if f.startswith(f"{i}:")] for i in looked}
        odd = F.greatest(F.lit(0), *[F.col(f"f{i}").isin(of[i]).cast("int") for i in looked if of[i]])
        rows = rows.withColumn("__odd", F.max(odd).over(by_key)).where("__odd = 0")
    rows = rows.where("__samples = 1").drop("__samples", "__odd")
    for i in looked:
        id_ = F.substring_index("__fid", ":", -1).cast("long")
        vectors = table.where(F.col("__fid").startswith(f"{i}:")).select(id_.alias(f"__id{i}"), F.col("__vec").alias(f"__vec{i}"))
        rows = rows.withColumn(f"__id{i}", F.when(F.col(f"f{i}") > 0, F.col(f"f{i}"))).join(F.broadcast(vectors), f"__id{i}", "left")
    vecs = [F.coalesce(f"__vec{i}", zeros(part_width)) if i in looked else zeros(part_width) for i in range(len(lists))]
    rows = rows.select(key, *carry, "pos", F.when(F.col("pos").isNotNull(), F.concat(*vecs)).alias("token"))
    rows = add(rows).select(key, *full, "pos", _apart("token"))
    rest = F.col("__samples") > 1
    if repeated:
        rest = rest | F.coalesce(F.arrays_overlap(F.concat(*fids), F.array(*[F.lit(f) for f in repeated])), F.lit(False))
    rest = dealt.withColumn("__samples", F.count(F.lit(1)).over(by_key)).where(rest)
    return PackedTokens(rows, unpacked(rest.drop("__samples")), parts)


def token_rows(tokens: PackedTokens) -> DataFrame:
    """All token rows, as ``sequence_tokens`` gives them."""
    return tokens.rows.unionByName(tokens.others)


def sequence_mean(tokens: DataFrame | PackedTokens, key: str, width: int, out: str = "vec") -> DataFrame:
    """(key, mean over all valid positions, zero ids included)."""
    if isinstance(tokens, PackedTokens):
        return sequence_mean(tokens.rows, key, width, out).unionByName(sequence_mean(tokens.others, key, width, out))
    summed = tokens.groupBy(key).agg(F.count("token").alias("__n"), *_sums("s", "token", width))
    return summed.select(key, _divided("s", width, "greatest(__n, 1)").alias(out))


def match_score(query: str, token: str, width: int, weights: Sequence[float] | None = None) -> str:
    """Score of a token for a query, as SQL text: a dot product, or supplied linear weights.

    The weights belong to [query, token, query - token, query * token], ``4 * width`` numbers.
    """
    pairs = [(f"get({query}, {i})", f"get({token}, {i})") for i in range(width)]
    if weights is None:
        return " + ".join(f"{q} * {s}" for q, s in pairs)
    if len(weights) != 4 * width:
        raise ValueError(f"expected {4 * width} weights, got {len(weights)}")
    own, other, gap, product = (
        [f"double('{w!r}')" for w in map(float, weights[i * width : (i + 1) * width])] for i in range(4)
    )
    return " + ".join(
        f"{q} * {own[i]} + {s} * {other[i]} + ({q} - {s}) * {gap[i]} + {q} * {s} * {product[i]}"
        for i, (q, s) in enumerate(pairs)
    )


def _softmax_state(pairs: str, width: int) -> Column:
    """Fold of (score, token) pairs into the softmax state (m, z, a), as SQL text.

    m is the largest score so far, z the sum of exp(score - m), a the sum of exp(score - m) * token;
    each step rescales the state by exp(m - m'), so no exponent ever exceeds 0.
    """
    zero = f"array({', '.join(['0D'] * width)})"
    start = f"named_struct('m', double('-Infinity'), 'z', 0D, 'a', {zero})"
    peak = "greatest(acc.m, p.score)"
    keep, add = f"exp(acc.m - {peak})", f"exp(p.score - {peak})"
    merged = ", ".join(f"get(acc.a, {i}) * {keep} + get(p.token, {i}) * {add}" for i in range(width))
    step = f"named_struct('m', {peak}, 'z', acc.z * {keep} + {add}, 'a', array({merged}))"
    return F.expr(f"aggregate(filter({pairs}, p -> p.token IS NOT NULL), {start}, (acc, p) -> {step})")


def _pooled_in_place(
    rows: DataFrame,
    key: str,
    width: int,
    query: str,
    weights: Sequence[float] | None,
    mean: str,
    attention: str,
) -> DataFrame:
    """``pool_tokens`` of rows that lie partitioned and sorted by ``key``.

    The largest score of a sample comes from a window in that order, which holds the tokens of one
    sample at a time; both means are plain sums then.
    """
    scored = rows.select(key, _apart("token"), F.expr(match_score(query, "token", width, weights)).alias("__score"))
    peaked = scored.withColumn("__peak", F.max("__score").over(Window.partitionBy(key)))
    weighed = peaked.withColumn("__w", F.exp(F.col("__score") - F.col("__peak")))
    summed = weighed.groupBy(key).agg(
        F.count("token").alias("__n"),
        F.count("__score").alias("__scored"),
        F.sum("__w").alias("__z"),
        *_sums("s", "token", width),
        *_sums("a", "token", width, "__w"),
    )
    # A token without a score, as of a vector with a null or too few values, leaves zeros, as in the fold.
    share = F.when(F.col("__scored") == F.col("__n"), _divided("a", width, "CASE WHEN __z > 0 THEN __z ELSE 1D END"))
    share = share.otherwise(zeros(width))
    return summed.select(key, _divided("s", width, "greatest(__n, 1)").alias(mean), share.alias(attention))


def pool_tokens(
    tokens: DataFrame | PackedTokens,
    key: str,
    width: int,
    query: str,
    weights: Sequence[float] | None = None,
    mean: str = "mean_vec",
    attention: str = "attention_vec",
) -> DataFrame:
    """(key, plain mean, mean weighted by the softmax of the match scores) from one exchange by ``key``.

    No window: the sums of the plain mean combine before the exchange, and the softmax is the
    fold of a mergeable state (running maximum, scaled sum, scaled weighted sums) over the scored
    tokens of a sample, which hold at most ``max_len`` tokens. Samples without tokens get zero
    vectors. Packed rows are pooled where they lie.
    """
    if weights is not None and len(weights) != 4 * width:
        raise ValueError(f"expected {4 * width} weights, got {len(weights)}")
    if isinstance(tokens, PackedTokens):
        others = pool_tokens(tokens.others, key, width, query, weights, mean, attention)
        others = others.repartition(tokens.parts, key) if tokens.parts else others
        return _pooled_in_place(tokens.rows, key, width, query, weights, mean, attention).unionByName(others)
    scored = tokens.withColumn("__score", F.expr(match_score(query, "token", width, weights)))
    summed = scored.groupBy(key).agg(
        F.count("token").alias("__n"),
        *_sums("s", "token", width),
        F.collect_list(F.struct(F.col("__score").alias("score"), F.col("token").alias("token"))).alias("__pairs"),
    )
    state = summed.withColumn("__state", _softmax_state("__pairs", width))
    share = F.expr(f"transform(__state.a, x -> x / CASE WHEN __state.z > 0 THEN __state.z ELSE 1D END)")
    return state.select(key, _divided("s", width, "greatest(__n, 1)").alias(mean), share.alias(attention))


def attention_pool(
    tokens: DataFrame | PackedTokens,
    key: str,
    width: int,
    query: str,
    weights: Sequence[float] | None = None,
    out: str = "vec",
) -> DataFrame:
    """(key, history summary conditioned on the query vector)."""
    return pool_tokens(tokens, key, width, query, weights, "__mean", out).drop("__mean")


def item_query(vectors: Sequence[str], width: int) -> Column:
    """Mean of the item-side vectors of a row, given as SQL text."""
    means = [f"({' + '.join(f'get({v}, {i})' for v in vectors)}) / {len(vectors)}" for i in range(width)]
    return F.expr(f"array({', '.join(means)})")


def match_features(
    df: DataFrame,
    key: str,
    item_vec: str | LateVector,
    user_ids: str,
    user_table: DataFrame,
    user_width: int,
    tokens: dict[str, DataFrame | PackedTokens],
    width: int,
    weights: dict[str, Sequence[float]] | None = None,
) -> DataFrame:
    """(key, ``match_<domain>``): item and user vectors followed by both summaries of a history.

    Every part is aggregated by ``key`` first, so the joins reuse that partitioning.
    ``tokens`` carry the column ``item_vec``; a late one is added to the joined rows.
    """
    late = item_vec if isinstance(item_vec, LateVector) else LateVector(item_vec, [item_vec], lambda rows: rows)
    joined = df.select(key, *late.columns).join(
        embed_mean(df, key, user_ids, user_table, user_width, "__user"), key
    )
    for domain, rows in tokens.items():
        pooled = pool_tokens(
            rows, key, width, late.name, (weights or {}).get(domain), f"__mean_{domain}", f"__att_{domain}"
        )
        joined = joined.join(pooled, key)
    return late.add(joined).withColumn("__user", _apart("__user")).select(
        key,
        *[
            F.concat(late.name, "__user", f"__mean_{d}", f"__att_{d}").alias(f"match_{d}")
            for d in tokens
        ],
    )
