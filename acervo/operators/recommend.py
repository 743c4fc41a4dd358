"""Batch recommendation: scoring, modes, cold start, exploration, similar games."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from acervo.fixed_values import (
    CANDIDATE_THRESHOLDS,
    COLD_START_TEXT,
    DEFAULT_MODE,
    FALLBACK_THRESHOLD,
    KNOWN_USER_TEXT,
    MODES,
)
from acervo.functions.lookup import skew_lookup
from acervo.functions.prefix import running_totals
from acervo.functions.sampling import PAIR_DRAWS, column_term, row_terms
from acervo.operators.pruned import CELL_ROWS, best_pairs, build_cells, map_reaching
from acervo.operators.tiles import dealt, distinct_rows, matrix, members, numbers, strips, tile_map, top_per_row
from acervo.session import cut_lineage, written


def mode_table(spark: SparkSession, k: int = 10) -> DataFrame:
    """Threshold and slot counts of each mode (three rows)."""
    rows = []
    for name, m in MODES.items():
        explore = int(k * m["exploracao"])
        rows.append((name, m["threshold"], m["exploracao"], explore, k - explore))
    return spark.createDataFrame(
        rows, "modo string, threshold double, exploracao double, n_explore int, n_top int"
    )


def mean_vector(users: DataFrame) -> DataFrame:
    """The mean of all user vectors, as one row."""
    parts = users.select(F.posexplode("vetor")).groupBy("pos").agg(F.avg("col").alias("m"))
    return parts.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("media")
    )


def with_cold_start(requests: DataFrame, users: DataFrame) -> DataFrame:
    """A vector for every request: the user's own, or the mean of all users."""
    known = users.select(F.col("id").alias("usuario_id"), "vetor")
    # one row is broadcast: the mean vector
    return requests.join(known, "usuario_id", "left").join(F.broadcast(mean_vector(users))).select(
        "usuario_id",
        F.coalesce("vetor", "media").alias("vetor"),
        F.when(F.col("vetor").isNotNull(), KNOWN_USER_TEXT).otherwise(COLD_START_TEXT).alias("explicacao"),
    )


def _sorted_items(items: pa.Table) -> pa.Table:
    return items.sort_by("id")


def _id_types(users: DataFrame, items: DataFrame) -> tuple[str, str, dict[str, pa.DataType]]:
    """SQL and Arrow types of the user and item ids (numbers or texts)."""
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    u, i = dict(users.dtypes)["usuario_id"], dict(items.dtypes)["id"]
    return u, i, {"usuario_id": arrow[u], "item": arrow[i]}


def score_summary(users: DataFrame, items: DataFrame, thresholds: Sequence[float] = (0.7, 0.5, 0.3)) -> DataFrame:
    """Every user scored against every item: count, bounds, mean, and hits per threshold."""
    names = [f"n_{int(round(t * 100))}" for t in thresholds]
    u_type, _i_type, ids = _id_types(users, items)

    def kernel(q: pa.Table, i: pa.Table) -> pa.Table:
        uid, qm, im = numbers(q, "usuario_id"), matrix(q, "vetor"), matrix(i, "vetor")
        cols: dict[str, list] = {c: [] for c in ("usuario_id", "n", "lo", "hi", "total", *names)}
        for part in strips(len(uid), i.num_rows) if i.num_rows else ():
            s = qm[part] @ im.T
            cols["usuario_id"].append(uid[part])
            cols["n"].append(np.full(len(s), s.shape[1], dtype=np.int64))
            cols["lo"].append(s.min(axis=1))
            cols["hi"].append(s.max(axis=1))
            cols["total"].append(s.sum(axis=1))
            for t, c in zip(thresholds, names):
                cols[c].append((s >= t).sum(axis=1).astype(np.int64))
        return _table(cols, ids | {c: pa.float64() for c in ("lo", "hi", "total")})

    fields = [f"usuario_id {u_type}", "n bigint", "lo double", "hi double", "total double"]
    schema = ", ".join(fields + [f"{c} bigint" for c in names])
    parts = tile_map(users, items, "usuario_id", "id", kernel, schema)
    return parts.groupBy("usuario_id").agg(
        F.sum("n").alias("n_itens"),
        F.min("lo").alias("menor"),
        F.max("hi").alias("maior"),
        (F.sum("total") / F.sum("n")).alias("media"),
        *[F.sum(c).alias(c) for c in names],
    )


def _table(cols: Mapping[str, list], kinds: Mapping[str, pa.DataType]) -> pa.Table:
    out = {}
    for name, parts in cols.items():
        kind = kinds.get(name, pa.int64())
        joined = np.concatenate(parts) if parts else np.empty(0)
        out[name] = pa.array(joined, type=kind) if parts else pa.array([], type=kind)
    return pa.table(out)


def _top_parts(users: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The ``n`` best items of every user in every item block, with the block's score bounds."""
    u_type, i_type, ids = _id_types(users, items)

    def kernel(q: pa.Table, i: pa.Table) -> pa.Table:
        i = _sorted_items(i)
        uid, iid = numbers(q, "usuario_id"), numbers(i, "id")
        qm, im = matrix(q, "vetor"), matrix(i, "vetor")
        cols: dict[str, list] = {"usuario_id": [], "item": [], "score": [], "lo": [], "hi": []}
        for part in strips(len(uid), len(iid)) if len(iid) else ():
            s = qm[part] @ im.T
            rows, at = top_per_row(s, n)
            cols["usuario_id"].append(uid[part][rows])
            cols["item"].append(iid[at])
            cols["score"].append(s[rows, at])
            cols["lo"].append(s.min(axis=1)[rows])
            cols["hi"].append(s.max(axis=1)[rows])
        return _table(cols, ids | {c: pa.float64() for c in ("score", "lo", "hi")})

    schema = f"usuario_id {u_type}, item {i_type}, score double, lo double, hi double"
    return tile_map(users, items, "usuario_id", "id", kernel, schema)


def _reaching(
    users: DataFrame, items: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, n: int, floor: float, cell_rows: int
) -> DataFrame:
    """``kernel`` over blocks that hold every user's ``n`` best items and all items of score ``floor`` or more.

    A catalogue of one cell leaves nothing out, so it is taken in plain blocks.
    """
    if items.count() <= cell_rows:
        return tile_map(users, items, "usuario_id", "id", kernel, schema)
    return map_reaching(users, build_cells(items, cell_rows), kernel, schema, n, floor)


def top_items(users: DataFrame, items: DataFrame, n: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The ``n`` best items of every user, ties by item id. Larger catalogues are searched cell by cell, best bounds first."""
    if items.count() > cell_rows:
        return best_pairs(users, build_cells(items, cell_rows), n)
    best = W.partitionBy("usuario_id").orderBy(F.desc("score"), "item")
    parts = _top_parts(users, items, n).drop("lo", "hi")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def filter_relax(scores: DataFrame, threshold: float, k: int) -> DataFrame:
    """Items at or above the threshold per user; where none is, the best 2k."""
    mine = W.partitionBy("usuario_id")
    # users with a hit and users without one are told apart by their best score; only the latter's scores are ranked
    best = scores.groupBy("usuario_id").agg(F.max("score").alias("_best"))
    relaxed = (
        scores.join(best.where(F.col("_best") < threshold), "usuario_id")
        .withColumn("place", F.row_number().over(mine.orderBy(F.desc("score"), "item")))
        .where(F.col("place") <= 2 * k)
        .select("usuario_id", "item", "score")
    )
    return scores.where(F.col("score") >= threshold).select("usuario_id", "item", "score").unionByName(relaxed)


def items_above(users: DataFrame, items: DataFrame, threshold: float, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """All items at or above the threshold for every user, out of all scores; where none is, the best 2k."""
    u_type, i_type, ids = _id_types(users, items)

    def kernel(q: pa.Table, i: pa.Table) -> pa.Table:
        i = _sorted_items(i)
        uid, iid = numbers(q, "usuario_id"), numbers(i, "id")
        qm, im = matrix(q, "vetor"), matrix(i, "vetor")
        cols: dict[str, list] = {"usuario_id": [], "item": [], "score": []}
        for part in strips(len(uid), len(iid)) if len(iid) else ():
            s = qm[part] @ im.T
            hit = s >= threshold
            # a user with a hit in this block needs no best items of it
            without = np.flatnonzero(~hit.any(axis=1))
            best, at = top_per_row(s[without], 2 * k)
            rows, cols_at = np.nonzero(hit)
            rows, cols_at = np.concatenate([rows, without[best]]), np.concatenate([cols_at, at])
            cols["usuario_id"].append(uid[part][rows])
            cols["item"].append(iid[cols_at])
            cols["score"].append(s[rows, cols_at])
        return _table(cols, ids | {"score": pa.float64()})

    parts = _reaching(users, items, kernel, f"usuario_id {u_type}, item {i_type}, score double", 2 * k, threshold, cell_rows)
    return filter_relax(cut_lineage(parts), threshold, k)


def threshold_lists(users: DataFrame, items: DataFrame, threshold: float, k: int, limit: int = 50, cell_rows: int = CELL_ROWS) -> DataFrame:
    """For every user the number of items at or above the threshold (``n_valid``) and the best ``limit`` of them; where none is, the best 2k.

    ``items_above`` gives all these items, as many rows as there are; here a user has ``limit`` or 2k rows at most.
    """
    u_type, i_type, ids = _id_types(users, items)
    most = max(limit, 2 * k)

    def kernel(q: pa.Table, i: pa.Table) -> pa.Table:
        i = _sorted_items(i)
        uid, iid = numbers(q, "usuario_id"), numbers(i, "id")
        qm, im = matrix(q, "vetor"), matrix(i, "vetor")
        cols: dict[str, list] = {c: [] for c in ("usuario_id", "item", "score", "n")}
        for part in strips(len(uid), len(iid)) if len(iid) else ():
            s = qm[part] @ im.T
            rows, at = top_per_row(s, most)
            valid = (s >= threshold).sum(axis=1)
            first = np.concatenate([[True], rows[1:] != rows[:-1]])  # the block's number of valid items goes with the user's first row
            for c, v in zip(cols, (uid[part][rows], iid[at], s[rows, at], np.where(first, valid[rows], 0))):
                cols[c].append(v)
        return _table(cols, ids | {"score": pa.float64()})

    schema = f"usuario_id {u_type}, item {i_type}, score double, n bigint"
    found = cut_lineage(_reaching(users, items, kernel, schema, 2 * k, threshold, cell_rows))
    counts = found.groupBy("usuario_id").agg(F.sum("n").alias("n_valid"))
    mine = W.partitionBy("usuario_id").orderBy(F.desc("score"), "item")
    top = found.drop("n").withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= most).join(counts, "usuario_id")
    listed = (F.col("score") >= threshold) & (F.col("rank") <= limit) | (F.col("n_valid") == 0) & (F.col("rank") <= 2 * k)
    return top.where(listed).select("usuario_id", "rank", "item", "score", "n_valid")


def recommend_modes(
    users: DataFrame, items: DataFrame, k: int = 10, modes: Sequence[str] | None = None, seed: int = 42, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """k slots per user and mode: the best valid items, then seeded exploration picks.

    Valid items score at least the mode's threshold; where none does, the best
    2k count as valid. The exploration slots are drawn from the valid items
    that are not already on the list, and stay empty unless there are more
    valid items than top slots.
    """
    if not 1 <= k <= 50:
        raise ValueError("k must lie in 1..50")
    names = list(MODES) if modes is None else list(modes)
    for name in names:
        if name not in MODES:
            raise ValueError(f"unknown mode {name}")
    slots = {m: (MODES[m]["threshold"], int(k * MODES[m]["exploracao"])) for m in names}
    number_of = {m: n for n, m in enumerate(names)}
    u_type, i_type, ids = _id_types(users, items)
    factor, offset = row_terms(F.col("usuario_id"), seed)
    users = users.select("usuario_id", "vetor", factor.alias("uf"), offset.alias("uo"))
    items = items.select("id", "vetor", column_term(F.col("id"), seed).alias("ix"))

    def kernel(q: pa.Table, i: pa.Table) -> pa.Table:
        i = _sorted_items(i)
        uid, iid = numbers(q, "usuario_id"), numbers(i, "id")
        uf, uo, ix = numbers(q, "uf"), numbers(q, "uo"), numbers(i, "ix")
        qm, im = matrix(q, "vetor"), matrix(i, "vetor")
        cols: dict[str, list] = {c: [] for c in ("usuario_id", "kind", "m", "item", "score", "sorteio", "n")}

        def emit(users_, kind, mode, item, score, drawn, n) -> None:
            size = len(users_)
            for c, v in zip(cols, (users_, kind, mode, item, score, drawn, n)):
                cols[c].append(v if isinstance(v, np.ndarray) else np.full(size, v))

        # users with one vector, as all without one of their own, have one row of scores; what differs is their draws
        vectors, number = distinct_rows(qm)
        order, begin = members(number, len(vectors))
        for part in strips(len(vectors), len(iid)) if len(iid) else ():
            s = vectors[part] @ im.T
            of = order[begin[part.start] : begin[part.stop]]
            u, row = uid[of], number[of] - part.start
            rows, at = top_per_row(s, 2 * k)
            who, place = dealt(rows, row, len(s))
            at = at[place]
            emit(u[who], 0, -1, iid[at], s[row[who], at], (uf[of][who] * ix[at] + uo[of][who]) % PAIR_DRAWS, 0)
            for m, (threshold, explore) in slots.items():
                valid = s >= threshold
                emit(u, 1, number_of[m], iid[:1].repeat(len(u)), 0.0, 0, valid.sum(axis=1)[row])
                for r in np.flatnonzero(valid.any(axis=1)) if explore else ():
                    same = order[begin[part.start + r] : begin[part.start + r + 1]]
                    good = np.flatnonzero(valid[r])
                    for some in strips(len(same), len(good)):
                        # k smallest draws suffice: at most n_top of them are on the list already
                        drawn = (uf[same[some]][:, None] * ix[good][None, :] + uo[same[some]][:, None]) % PAIR_DRAWS
                        rows, cs = top_per_row(-drawn, k)
                        emit(uid[same[some]][rows], 2, number_of[m], iid[good[cs]], s[r, good[cs]], drawn[rows, cs], 0)
        return _table(cols, ids | {"score": pa.float64()})

    found = cut_lineage(_reaching(  # scored once, read by kind
        users, items, kernel, f"usuario_id {u_type}, kind bigint, m bigint, item {i_type}, score double, sorteio bigint, n bigint",
        2 * k, min(threshold for threshold, _ in slots.values()), cell_rows,
    ))
    table = F.broadcast(  # one row per mode
        mode_table(users.sparkSession, k)
        .where(F.col("modo").isin(names))
        .withColumn("m", F.element_at(F.create_map(*[F.lit(x) for kv in number_of.items() for x in kv]), F.col("modo")).cast("bigint"))
    )
    mine = W.partitionBy("usuario_id")
    top = (
        found.where("kind = 0")
        .withColumn("place", F.row_number().over(mine.orderBy(F.desc("score"), "item")))
        .where(F.col("place") <= 2 * k)
        .select("usuario_id", "item", "score", "place", "sorteio")
    )
    counts = found.where("kind = 1").groupBy("usuario_id", "m").agg(F.sum("n").alias("n_valid")).join(table, "m")
    listed = (
        top.join(counts, "usuario_id")
        .where((F.col("score") >= F.col("threshold")) | (F.col("n_valid") == 0))
        .withColumn("relaxed", F.col("n_valid") == 0)
    )
    chosen = listed.where(F.col("place") <= F.col("n_top")).select(
        "usuario_id", "m", "item", "score", F.lit("topo").alias("origem"), F.col("place").cast("bigint").alias("o")
    )
    pool_valid = found.where("kind = 2").select("usuario_id", "m", "item", "score", "sorteio").join(
        counts.where("n_valid > n_top").select("usuario_id", "m", "n_explore"), ["usuario_id", "m"]
    )
    pool_relaxed = listed.where("relaxed AND place > n_top").select(
        "usuario_id", "m", "item", "score", "sorteio", "n_explore"
    )
    lot = W.partitionBy("usuario_id", "m").orderBy("sorteio", "item")
    explored = (
        pool_valid.join(chosen.select("usuario_id", "m", "item"), ["usuario_id", "m", "item"], "left_anti")
        .unionByName(pool_relaxed)
        .withColumn("o", F.row_number().over(lot))
        .where(F.col("o") <= F.col("n_explore"))
        .select("usuario_id", "m", "item", "score", F.lit("exploracao").alias("origem"), F.col("o").cast("bigint"))
    )
    slot = W.partitionBy("usuario_id", "m").orderBy(F.desc("origem"), "o")
    return (
        chosen.unionByName(explored)
        .join(table.select("m", "modo"), "m")
        .select("usuario_id", "modo", F.row_number().over(slot).alias("rank"), "item", "score", "origem")
    )


def recommend(users: DataFrame, items: DataFrame, k: int = 10, mode: str | None = None, seed: int = 42) -> DataFrame:
    return recommend_modes(users, items, k, [mode or DEFAULT_MODE], seed)


def popular_items(sessions: DataFrame, k: int = 10) -> DataFrame:
    """Most played items of all time."""
    return (
        sessions.groupBy(F.col("jogo_id").alias("item"))
        .agg(F.count("*").alias("acessos"))
        .orderBy(F.desc("acessos"), "item")
        .limit(k)
    )


def cascade(recs: DataFrame, good_items: DataFrame, clusters: DataFrame) -> DataFrame:
    """Recommendations kept to items predicted good, with the user's archetype."""
    kept = recs.join(good_items.select("item"), "item", "left_semi")
    return kept.join(clusters.select("usuario_id", "cluster"), "usuario_id", "left")


def similar_games(games: DataFrame, bridge: DataFrame, k: int = 10) -> DataFrame:
    """For every game the k games sharing most categories, then best rated.

    Games with the same category set are interchangeable apart from their
    rating, so sets are compared instead of games: per set only the k + 1 best
    games can matter, and per set only the k + 1 best partner sets.
    """
    keep = k + 1
    cats = bridge.groupBy(F.col("jogo_id").alias("id")).agg(F.array_sort(F.collect_set("nome")).alias("cats"))
    rated = games.select("id", F.col("avaliacao_media").alias("nota")).join(cats, "id")
    rated = rated.withColumn("sig", F.md5(F.to_json("cats"))).withColumn("nota", F.coalesce("nota", F.lit(-1.0)))
    best = W.partitionBy("sig").orderBy(F.desc("nota"), "id")
    leaders = cut_lineage(
        rated.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= keep)
        .groupBy("sig")
        .agg(
            F.array_sort(F.collect_list(F.struct("place", "id", "nota"))).alias("jogos"),
            F.first("cats").alias("cats"),
        )
        .select("sig", "cats", "jogos", F.col("jogos")[0]["nota"].alias("nota"), F.col("jogos")[0]["id"].alias("id"))
    )
    partner = leaders.select(F.col("sig").alias("par"), "jogos")
    per_sig = W.partitionBy("sig")
    near = (
        similar_sets(leaders, keep)
        .join(partner, "par")
        .select("sig", "comuns", F.explode("jogos").alias("g"))
        .select("sig", "comuns", F.col("g.id").alias("id"), F.col("g.nota").alias("nota"))
        .withColumn("place", F.row_number().over(per_sig.orderBy(F.desc("comuns"), F.desc("nota"), "id")))
        .where(F.col("place") <= keep)
        .groupBy("sig")
        .agg(F.array_sort(F.collect_list(F.struct("place", "id", "comuns"))).alias("lista"))
    )
    others = F.filter("lista", lambda x: x["id"] != F.col("id"))
    # one set may be that of very many games: its list is looked up without piling them up
    sizes = rated.groupBy("sig").agg(F.count("*").alias("n"))
    return (
        skew_lookup(rated.select("id", "sig"), near.join(sizes, "sig"), "sig", ["lista"], F.col("id"))
        .select(F.col("id").alias("jogo_id"), F.posexplode(F.slice(others, 1, k)).alias("rank", "g"))
        .select("jogo_id", (F.col("rank") + 1).alias("rank"), F.col("g.id").alias("similar_id"), F.col("g.comuns").alias("categorias_comuns"))
    )


def similar_sets(leaders: DataFrame, keep: int) -> DataFrame:
    """For every set the ``keep`` sets with most common members, then best ``nota``, then smallest ``id``: sig, par, comuns.

    ``leaders`` has a row for each distinct set: sig, cats, nota, id. An inverted index holds,
    for every member, the sets with it. The ``keep`` best rated sets of each member are counted first. They hold
    all that share a single member and can win, and give each set a number of common
    members (``least``) and a rating that its list reaches already. A set that does better shares at
    least two members, and so many that the two sets meet within their rarest
    members: all but the last ``least`` - 1 of each, in one order of the members by frequency. Only these meet, and frequent
    members are the last of their sets; what meets is counted exactly.
    """
    flat = leaders.select("sig", "nota", "id", F.size("cats").alias("m"), F.explode("cats").alias("c"))
    often = flat.groupBy("c").agg(F.count("*").alias("df"))
    from_rarest = W.partitionBy("sig").orderBy("df", "c")  # the members of one set
    postings = cut_lineage(flat.join(often, "c").withColumn("pos", F.row_number().over(from_rarest)).drop("df"))
    sets = leaders.select("sig", "cats")
    their = leaders.select(F.col("sig").alias("par"), F.col("cats").alias("outros"), "nota", "id")

    def counted(pairs: DataFrame) -> DataFrame:
        both = pairs.select("sig", "par").distinct().join(sets, "sig").join(their, "par")
        return both.select("sig", "par", F.size(F.array_intersect("cats", "outros")).cast("bigint").alias("comuns"), "nota", "id")

    order = [F.desc("comuns"), F.desc("nota"), F.col("id")]
    top = W.partitionBy("sig").orderBy(*order)
    best_rated = W.partitionBy("c").orderBy(F.desc("nota"), "id")
    champions = postings.withColumn("o", F.row_number().over(best_rated)).where(F.col("o") <= keep).select("c", F.col("sig").alias("par"))
    first = counted(postings.select("sig", "c").join(champions, "c")).withColumn("o", F.row_number().over(top)).where(F.col("o") <= keep)
    first = cut_lineage(first)
    reached = first.where(F.col("o") == keep).select("sig", F.col("comuns").alias("least"), F.col("nota").alias("floor"))
    asking = postings.join(reached, "sig", "left").select(
        "sig", "c", "m", "pos", F.greatest(F.coalesce("least", F.lit(0)), F.lit(2)).alias("need"), F.coalesce("least", F.lit(0)).alias("least"),
        F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    asking = asking.where(F.col("m") - F.col("pos") + 1 >= F.col("need"))
    other = postings.select("c", F.col("sig").alias("par"), F.col("m").alias("m2"), F.col("pos").alias("pos2"), F.col("nota").alias("nota2"))
    could = 1 + F.least(F.col("m") - F.col("pos"), F.col("m2") - F.col("pos2"))  # if this is the first member they share
    meets = (could >= F.col("need")) & ((could > F.col("least")) | (F.col("nota2") >= F.col("floor")))
    found = counted(asking.join(other, "c").where(meets)).unionByName(first.drop("o")).distinct()
    return found.withColumn("o", F.row_number().over(top)).where(F.col("o") <= keep).select("sig", "par", "comuns")


def holdout_latest(sessions: DataFrame, frac: float = 0.2) -> DataFrame:
    """Games in the latest ``frac`` of each user's sessions (at least one session).

    The timeline is cut into time buckets, so one very active user is spread
    over many tasks.
    """
    cells = (
        sessions.groupBy("usuario_id", "inicio", "jogo_id")
        .agg(F.count("*").alias("n"))
        .withColumn("_t", F.unix_micros(F.col("inicio").cast("timestamp")))
    )
    run = running_totals(cells, "_t", ["n"], ["usuario_id"], [F.col("_t"), F.col("jogo_id")])
    latest = F.greatest(F.lit(1), F.floor(F.col("n_total") * F.lit(frac)))
    kept = run.where(F.col("n_before") + F.col("n") > F.col("n_total") - latest)
    return kept.select("usuario_id", F.col("jogo_id").alias("item")).distinct()


def _extremes(users: DataFrame, items: DataFrame, k: int, cell_rows: int) -> DataFrame:
    """The ``k`` best items of every user with the user's least and largest score of all (``lo``, ``hi``, at least on some row)."""
    if items.count() <= cell_rows:
        return _top_parts(users, items, k)
    cells = build_cells(items, cell_rows)
    top = best_pairs(users, cells, k).select("usuario_id", "item", "score", F.col("score").alias("hi"))
    against = users.withColumn("vetor", F.transform("vetor", lambda x: -x))
    least = best_pairs(against, cells, 1).select("usuario_id", (-F.col("score")).alias("lo"))
    return top.join(least, "usuario_id")


def best_thresholds(users: DataFrame, items: DataFrame, truth: DataFrame, k: int = 10, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The candidate threshold with the best precision of each user with a truth set.

    Scores are scaled to 0..1 within the user. The items at or above a
    threshold are the head of the user's ranking, so the k best items serve
    every candidate. Constant scores give the fallback threshold.
    """
    truth = written(truth.select("usuario_id", "item"))  # read twice
    span = F.col("maior") - F.col("menor")
    # k rows per user and item block: the user's window is short
    mine = W.partitionBy("usuario_id")
    scaled = (
        _extremes(users, items, k, cell_rows)
        .withColumn("menor", F.min("lo").over(mine))
        .withColumn("maior", F.max("hi").over(mine))
        .withColumn("place", F.row_number().over(mine.orderBy(F.desc("score"), "item")))
        .where(F.col("place") <= k)
        .withColumn("s", F.coalesce(F.try_divide(F.col("score") - F.col("menor"), span), F.lit(0.0)))
        .join(truth.withColumn("_t", F.lit(1)), ["usuario_id", "item"], "left")
        .withColumn("hit", F.coalesce("_t", F.lit(0)))
    )
    picks = []
    for t in CANDIDATE_THRESHOLDS:
        inside = F.col("s") >= t
        precision = F.try_divide(F.sum(F.when(inside, F.col("hit"))), F.count_if(inside))
        picks.append(F.struct((-precision).alias("p"), F.lit(t).alias("t")))
    ranked = F.array_sort(F.filter(F.array(*picks), lambda x: x["p"].isNotNull()))
    first = F.try_element_at(ranked, F.lit(1))
    out = scaled.groupBy("usuario_id").agg(first.alias("b"))
    return out.join(truth.select("usuario_id").distinct(), "usuario_id", "left_semi").select(
        "usuario_id",
        F.coalesce(F.col("b.t"), F.lit(FALLBACK_THRESHOLD)).alias("best_threshold"),
        F.coalesce(-F.col("b.p"), F.lit(0.0)).alias("best_precision"),
    )
