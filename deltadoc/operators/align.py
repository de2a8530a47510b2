"""Section and block alignment of two versions, for all comparisons at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltadoc import fixed
from deltadoc.functions import similarity as S
from deltadoc.functions import text as T
from deltadoc.operators.assign import assign, spread
from deltadoc.operators.cut import cut


def _prefixed(df: DataFrame, end: str, keep: tuple[str, ...] = ("cmp_id",)) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{c}_{end}") for c in df.columns])


def align_sections(sections: DataFrame, blocks: DataFrame, entities: DataFrame, mode: str = "best") -> DataFrame:
    """Matched, added and removed sections of each comparison.

    All tables: cmp_id and side (A or B). All sections of one version meet all of the other; five signals
    score a pair. The result has al_no (the order of rows within a comparison), status, section_id_a/b,
    order_a/b, confidence and signals.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "normalized"))), lambda b: b.normalized), " ")
    texts = blocks.groupBy("cmp_id", "side", "section_id").agg(F.array_join(S.word_set(text), " ").alias("words"))
    value = F.coalesce(F.col("value_str"), F.col("value_num").cast("string"))
    values = entities.groupBy("cmp_id", "side", "section_id").agg(F.collect_set(F.concat_ws(":", "type", value)).alias("values"))
    size = F.count("*").over(Window.partitionBy("cmp_id", "side"))
    leaf = sections.join(texts, ["cmp_id", "side", "section_id"]).join(values, ["cmp_id", "side", "section_id"], "left").withColumn("n", size)
    title = F.col("normalized_heading")
    leaf = leaf.select("cmp_id", "side", "section_id", F.col("order_index").alias("order"), "section_number", "normalized_heading", F.array_join(S.word_set(title), " ").alias("title"), S.family_of(title).alias("family"), "words", F.coalesce("values", F.array().cast("array<string>")).alias("values"), "n")
    leaf = cut(leaf)
    a, b = (_prefixed(leaf.where(F.col("side") == s).drop("side"), s.lower()) for s in "AB")
    pairs = a.join(b, "cmp_id").select(
        "cmp_id", "section_id_a", "section_id_b", "order_a", "order_b",
        F.struct(
            S.heading_score(F.col("normalized_heading_a"), F.col("normalized_heading_b"), (F.col("title_a"), F.col("family_a")), (F.col("title_b"), F.col("family_b"))).alias("heading"),
            S.set_ratio(F.col("words_a"), F.col("words_b")).alias("content"),
            S.jaccard(F.col("values_a"), F.col("values_b")).alias("entity"),
            S.position_similarity(F.col("order_a"), F.col("n_a"), F.col("order_b"), F.col("n_b")).alias("position"),
            S.numbering_similarity(F.col("section_number_a"), F.col("section_number_b")).alias("numbering"),
        ).alias("signals"),
    )
    weights = {"heading": fixed.W_HEADING, "content": fixed.W_CONTENT, "entity": fixed.W_ENTITY, "position": fixed.W_POSITION, "numbering": fixed.W_NUMBERING}
    score = sum((F.col(f"signals.{k}") * w for k, w in list(weights.items())[1:]), F.col("signals.heading") * fixed.W_HEADING)
    found = cut(assign(pairs.withColumn("score", score), ["cmp_id"], "order_a", "order_b", "score", fixed.SECTION_THRESHOLD, mode=mode))
    matched = found.select("cmp_id", F.lit("MATCHED").alias("status"), "section_id_a", "section_id_b", "order_a", "order_b", T.half_up(F.col("score"), 4).alias("confidence"), "signals")
    alone = [matched]
    for own, other, status in (("a", "b", "REMOVED"), ("b", "a", "ADDED")):
        rows = (a if own == "a" else b).select("cmp_id", f"section_id_{own}", f"order_{own}").join(matched.select("cmp_id", f"section_id_{own}"), ["cmp_id", f"section_id_{own}"], "left_anti")
        alone.append(rows.select("cmp_id", F.lit(status).alias("status"), f"section_id_{own}", F.lit(None).cast("string").alias(f"section_id_{other}"), f"order_{own}", F.lit(None).cast("int").alias(f"order_{other}"), F.lit(1.0).alias("confidence"), F.lit(None).cast(matched.schema["signals"].dataType).alias("signals")))
    rows = alone[0].unionByName(alone[1]).unionByName(alone[2])
    order = Window.partitionBy("cmp_id").orderBy(F.coalesce("order_a", "order_b"), F.col("order_a").isNull())
    return rows.withColumn("al_no", F.row_number().over(order))


def term_weights(blocks: DataFrame, key: str = "cmp_id") -> DataFrame:
    """Weight of each content term of a comparison: rarer among its blocks is heavier."""
    terms = blocks.select(key, F.posexplode(T.distinct_terms(F.col("normalized"))).alias("at", "term"))
    df = cut(terms.groupBy(key, "term").agg(F.count("*").alias("df"), F.count_if(F.col("at") == 0).alias("firsts")))
    total = df.groupBy(key).agg(F.sum("firsts").alias("total"))  # a block with terms has one first term
    return df.join(total, key).select(key, "term", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 0.1).alias("weight"))


def _comparable(blocks: DataFrame) -> DataFrame:
    return blocks.where(~F.col("block_type").isin("header", "footer", "table", "heading") & (F.col("normalized") != ""))


def _posted(rows: DataFrame, weights: DataFrame, scope: list[str]) -> DataFrame:
    """scope, n, mass (all weight of the block), term, weight and after: the weight from this term on, heaviest first."""
    terms = rows.select(*{"cmp_id", *scope}, "n", F.explode(T.distinct_terms(F.col("normalized"))).alias("term")).join(weights, ["cmp_id", "term"])
    own = Window.partitionBy(*scope, "n")
    return terms.withColumn("mass", F.sum("weight").over(own)).withColumn("after", F.sum("weight").over(own.orderBy(F.desc("weight"), "term").rowsBetween(0, Window.unboundedFollowing)))


def _met(short: DataFrame, long: DataFrame, scope: list[str], share: float, hot: int) -> DataFrame:
    """Pairs (n of ``short`` as x, n of ``long`` as y) that share one of the heaviest terms of x, x being no heavier.

    A term of more than ``hot`` blocks x is split into as many parts as keep each below it; blocks y go to all of them.
    """
    key = [*scope, "term"]
    x = short.where(F.col("after") >= share * F.col("mass") - 1e-9).select(*key, F.col("n").alias("x"), F.col("mass").alias("mass_x"))
    many = x.groupBy(*key).agg(F.ceil(F.count("*") / hot).cast("int").alias("parts")).where("parts > 1")
    x = x.join(many, key, "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("x"), F.col("parts"))).otherwise(0).cast("int")).drop("parts")
    y = long.select(*key, F.col("n").alias("y"), F.col("mass").alias("mass_y"), "after").join(many, key, "left")
    y = y.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return x.join(y, [*key, "part"]).where((F.col("mass_x") <= F.col("mass_y")) & (F.col("after") >= share * F.col("mass_x") - 1e-9)).select(*scope, "x", "y")


def candidate_pairs(terms_a: DataFrame, terms_b: DataFrame, scope: list[str], share: float, hot: int = 1000) -> DataFrame:
    """scope, n_a and n_b of all blocks whose common weight may be ``share`` of the lighter one's mass.

    Terms have one order, the heaviest first. What two blocks share can't weigh more than what either has from
    their first common term on; so that term must be among the lighter block's first ones, those behind which
    at least ``share`` of its mass is left, and only these are met with all terms of the other side.
    """
    ways = [_met(terms_a, terms_b, scope, share, hot).withColumnsRenamed({"x": "n_a", "y": "n_b"}), _met(terms_b, terms_a, scope, share, hot).withColumnsRenamed({"x": "n_b", "y": "n_a"})]
    return ways[0].unionByName(ways[1]).distinct()


def block_classes(blocks: DataFrame, scope: list[str]) -> DataFrame:
    """Blocks with ``rep``, the first of those of equal text and type within the scope; rows of tables with a key stay alone."""
    alone = F.when((F.col("block_type") == "table_row") & F.col("row_key").isNotNull(), F.col("n"))
    return blocks.withColumn("_alone", alone).withColumn("rep", F.min("n").over(Window.partitionBy(*scope, "block_type", "normalized", "_alone"))).drop("_alone")


def _both_classes(a: DataFrame, b: DataFrame, scope: list[str]) -> dict[str, DataFrame]:
    both = cut(block_classes(a.withColumn("side", F.lit("A")).unionByName(b.withColumn("side", F.lit("B"))), [*scope, "side"]))
    return {s: both.where(F.col("side") == s).drop("side") for s in "AB"}


def block_pairs(a: DataFrame, b: DataFrame, weights: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """Scored pairs of blocks within a ``scope`` that can reach ``threshold``.

    A pair's score is 0.45 of its lexical similarity and 0.55 of its shared weight of terms, so pairs that
    reach the threshold share a part of their terms' weight: they meet by ``candidate_pairs``, and those that share
    too little, or whose lengths differ too much, are left out before texts are compared. Blocks that
    ``block_classes`` gives the same ``rep`` are one here, with how many they are in ``room_a`` and ``room_b``.
    """
    share = (threshold - 1e-9 - fixed.W_LEXICAL) / fixed.W_TERMS
    own = [*scope, "side"]
    both = a.withColumn("side", F.lit("A")).unionByName(b.withColumn("side", F.lit("B")))
    same = [F.first(c).alias(c) for c in ("block_type", "normalized", "row_key", *(() if "cmp_id" in scope else ("cmp_id",)))]
    reps = both.groupBy(*own, "rep").agg(F.count("*").cast("int").alias("room"), *same).withColumnRenamed("rep", "n")
    terms = cut(_posted(reps, weights, own))
    posted = [terms.where(F.col("side") == s).drop("side") for s in "AB"]
    weighed = terms.groupBy(*own, "n").agg(F.first("mass").alias("mass"), F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    rows = reps.join(weighed, [*own, "n"]).withColumn("key", T.strip_list_marker(F.col("normalized")))
    rows = rows.withColumns({"sorted": S.sorted_words(F.col("key")), "tokens": T.tokens(F.col("key"))}).withColumn("sizes", F.array(F.length("key"), F.length("sorted")))
    sides = [rows.where(F.col("side") == s.upper()).select(*scope, *[F.col(c).alias(f"{c}_{s}") for c in ("n", "room", "mass", "terms", "sizes", "block_type", "normalized", "row_key", "key", "sorted", "tokens")]) for s in "ab"]
    met = candidate_pairs(*posted, scope, share).join(sides[0], [*scope, "n_a"]).join(sides[1], [*scope, "n_b"])
    met = met.where("block_type_a = block_type_b or (block_type_a != 'table_row' and block_type_b != 'table_row')")
    names = F.transform("terms_b", lambda t: t["term"])
    shared = F.aggregate(F.filter("terms_a", lambda t: F.array_contains(names, t["term"])), F.lit(0.0), lambda s, t: s + t["weight"])
    met = met.withColumn("shared", shared).withColumn("terms", F.col("shared") / F.least("mass_a", "mass_b"))
    # No common subsequence is longer than the shorter text.
    most = lambda k: F.when(F.col("sizes_a")[k] + F.col("sizes_b")[k] > 0, 2 * F.least(F.col("sizes_a")[k], F.col("sizes_b")[k]) / (F.col("sizes_a")[k] + F.col("sizes_b")[k])).otherwise(F.lit(1.0))
    met = met.where(F.col("terms") * fixed.W_TERMS + F.greatest(most(0), most(1)) * fixed.W_LEXICAL >= threshold - 1e-9)
    met = met.withColumn("start", S.common_start(F.col("tokens_a"), F.col("tokens_b")))
    of = [tuple(F.col(f"{c}_{s}") for c in ("key", "sorted", "tokens")) for s in "ab"]
    score = F.least(F.lit(1.0), S.lexical_score(*of, F.col("start")) * fixed.W_LEXICAL + F.col("terms") * fixed.W_TERMS)
    return met.withColumn("score", score)


def _scored(pairs: DataFrame, *keep: str) -> DataFrame:
    return cut(pairs.select("cmp_id", *keep, "n_a", "n_b", "room_a", "room_b", "score"))


def anchors(a: DataFrame, b: DataFrame, scope: list[str]) -> DataFrame:
    """scope, n_a and n_b of blocks of equal ``key``, each used once, the first with the first."""
    turn = F.row_number().over(Window.partitionBy(*scope, "key").orderBy("n")).alias("turn")
    one = lambda df, end: df.select(*scope, "key", turn, F.col("n").alias(f"n_{end}"))
    return one(a, "a").join(one(b, "b"), [*scope, "key", "turn"]).drop("key", "turn")


def _members(found: DataFrame, classes: dict[str, DataFrame], scope: list[str]) -> DataFrame:
    """Assigned pairs of classes as pairs of blocks; classes of one block each are that already."""
    found = cut(found)
    one = found.where("room_a = 1 and room_b = 1").drop("times", "room_a", "room_b")
    more = found.where("room_a > 1 or room_b > 1").drop("room_a", "room_b")
    if more.isEmpty():
        return one
    members = [df.select(*scope, F.lit(side).alias("side"), "rep", "n") for side, df in classes.items()]
    return one.unionByName(spread(more, members[0].unionByName(members[1]), scope, "n_a", "n_b"))


def align_blocks(blocks: DataFrame, alignments: DataFrame) -> DataFrame:
    """Unchanged, modified, moved, removed and added blocks of each comparison.

    ``blocks``: cmp_id, side, section_id and the block's columns. The result has status, n_a and n_b (block
    numbers), similarity and al_no, the section alignment that it belongs to.
    """
    weights = cut(term_weights(blocks))
    keep = ["cmp_id", "section_id", F.col("block_index").alias("n"), "block_type", "normalized", "row_key"]
    sides = {}
    for s in "AB":
        own = _comparable(blocks.where(F.col("side") == s)).select(*keep)
        where = alignments.where(F.col(f"section_id_{s.lower()}").isNotNull()).select("cmp_id", F.col(f"section_id_{s.lower()}").alias("section_id"), "al_no", "status")
        sides[s] = own.join(where, ["cmp_id", "section_id"]).withColumn("key", T.strip_list_marker(F.col("normalized")))
    a, b = cut(sides["A"]), cut(sides["B"])
    same = anchors(a.where("status = 'MATCHED'"), b.where("status = 'MATCHED'"), ["cmp_id", "al_no"])
    same = cut(same).select("cmp_id", "al_no", F.lit("UNCHANGED").alias("status"), "n_a", "n_b", F.lit(1.0).alias("similarity"))
    less = lambda df, done, end: df.join(done.select("cmp_id", F.col(f"n_{end}").alias("n")), ["cmp_id", "n"], "left_anti")
    rest_a, rest_b = less(a, same, "a"), less(b, same, "b")
    scope = ["cmp_id", "al_no"]
    classes = _both_classes(rest_a.where("status = 'MATCHED'"), rest_b.where("status = 'MATCHED'"), scope)
    texts = block_pairs(classes["A"], classes["B"], weights, scope, fixed.BLOCK_THRESHOLD)
    texts = texts.where("block_type_a != 'table_row' or row_key_a is null or row_key_b is null")
    texts = _scored(texts, "al_no")
    row = lambda df, end: df.where("block_type = 'table_row' and row_key is not null and status = 'MATCHED'").select(*scope, F.col("n").alias(f"n_{end}"), F.col("row_key").alias(f"key_{end}"))
    alike = S.ratio(F.col("key_a"), F.col("key_b"))
    rows = row(rest_a, "a").join(row(rest_b, "b"), scope).withColumn("r", alike)
    rows = rows.select(*scope, "n_a", "n_b", F.lit(1).alias("room_a"), F.lit(1).alias("room_b"), F.when(F.col("r") >= 0.85, F.greatest(F.lit(0.9), F.col("r"))).otherwise(F.col("r") * 0.5).alias("score"))
    changed = cut(_members(assign(texts.unionByName(cut(rows)), scope, "n_a", "n_b", "score", fixed.BLOCK_THRESHOLD, room=("room_a", "room_b")), classes, scope))
    changed = changed.select("cmp_id", "al_no", F.lit("MODIFIED").alias("status"), "n_a", "n_b", T.half_up(F.col("score"), 4).alias("similarity"))
    left_a, left_b = less(rest_a, changed, "a"), less(rest_b, changed, "b")
    classes = _both_classes(left_a, left_b, ["cmp_id"])
    moves = block_pairs(classes["A"], classes["B"], weights, ["cmp_id"], fixed.MOVE_THRESHOLD).where("block_type_a = block_type_b")
    moved = assign(_scored(moves), ["cmp_id"], "n_a", "n_b", "score", fixed.MOVE_THRESHOLD, room=("room_a", "room_b"))
    moved = cut(_members(moved, classes, ["cmp_id"])).join(left_a.select("cmp_id", F.col("n").alias("n_a"), "al_no"), ["cmp_id", "n_a"])
    moved = moved.select("cmp_id", "al_no", F.lit("MOVED").alias("status"), "n_a", "n_b", T.half_up(F.col("score"), 4).alias("similarity"))
    gone = less(left_a, moved, "a").select("cmp_id", "al_no", F.lit("REMOVED").alias("status"), F.col("n").alias("n_a"), F.lit(None).cast("int").alias("n_b"), F.lit(0.0).alias("similarity"))
    new = less(left_b, moved, "b").select("cmp_id", "al_no", F.lit("ADDED").alias("status"), F.lit(None).cast("int").alias("n_a"), F.col("n").alias("n_b"), F.lit(0.0).alias("similarity"))
    return same.unionByName(changed).unionByName(moved).unionByName(gone).unionByName(new)


def ambiguous(alignments: DataFrame, sections: DataFrame) -> DataFrame:
    """Cases for arbitration: matched sections with unmatched rivals of nearly as good a heading.

    A row for each rival, at most three a case and six cases a comparison, with rank and score.
    """
    heading = lambda s: sections.where(F.col("side") == s).select("cmp_id", F.col("section_id").alias(f"section_id_{s.lower()}"), F.col("normalized_heading").alias(f"heading_{s.lower()}"))
    matched = alignments.where("status = 'MATCHED'").join(heading("A"), ["cmp_id", "section_id_a"]).join(heading("B"), ["cmp_id", "section_id_b"])
    matched = matched.withColumn("chosen", S.heading_similarity(F.col("heading_a"), F.col("heading_b")))
    free = alignments.where("status = 'ADDED'").select("cmp_id", "section_id_b", F.col("order_b").alias("rival_order")).join(heading("B"), ["cmp_id", "section_id_b"]).select("cmp_id", F.col("section_id_b").alias("rival"), "rival_order", F.col("heading_b").alias("rival_heading"))
    pairs = matched.join(free, "cmp_id").withColumn("score", S.heading_similarity(F.col("heading_a"), F.col("rival_heading")))
    pairs = pairs.where((F.col("score") >= F.col("chosen") - fixed.ARBITRATION_MARGIN) & (F.col("score") > 0.4))
    rank = F.row_number().over(Window.partitionBy("cmp_id", "section_id_a").orderBy(F.desc("score"), "rival_order"))
    case = F.dense_rank().over(Window.partitionBy("cmp_id").orderBy("al_no"))
    pairs = pairs.withColumn("rank", rank).withColumn("case", case).where((F.col("rank") <= fixed.ARBITRATION_RIVALS) & (F.col("case") <= fixed.ARBITRATION_CASES))
    return pairs.select("cmp_id", "case", "al_no", "section_id_a", "section_id_b", "rival", "rank", "score")


def arbitrated(alignments: DataFrame, choices: DataFrame, mode: str = "split") -> DataFrame:
    """Alignments with decisions (cmp_id, section_id_a, choice): null splits a match into removed and added.

    In mode ``split`` other choices change nothing, as every rival is a section of the result already. In mode
    ``fixed`` a choice of an added section pairs it with the one asked about: its added row goes, and the former
    partner, which may not be paired with that section again, is added. Of several cases that choose one
    section the surest gets it (column ``confidence``, where there is one), then the first in order; the
    others keep their matches. Of several decisions on one section the surest counts, then a null, then the least.
    """
    if mode not in ("split", "fixed"):
        raise ValueError(f"unknown mode of arbitration: {mode}")
    sure = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) if "confidence" in choices.columns else F.lit(0.0)
    asked = choices.select("cmp_id", "section_id_a", F.col("choice").alias("_choice"), sure.alias("_sure"))
    asked = asked.where("section_id_a is not null" if mode == "fixed" else "section_id_a is not null and _choice is null")
    first = F.row_number().over(Window.partitionBy("cmp_id", "section_id_a").orderBy(F.desc("_sure"), F.col("_choice").asc_nulls_first()))
    asked = asked.withColumn("_n", first).where("_n = 1").drop("_n").withColumn("_asked", F.lit(True))
    rows = alignments.join(asked, ["cmp_id", "section_id_a"], "left")
    rows = rows.withColumn("_split", F.col("_asked").isNotNull() & F.col("_choice").isNull() & (F.col("status") == "MATCHED"))
    free = alignments.where("status = 'ADDED'").select("cmp_id", F.col("section_id_b").alias("_choice"), F.col("order_b").alias("_order"))
    rows = rows.join(free, ["cmp_id", "_choice"], "left")
    turn = F.row_number().over(Window.partitionBy("cmp_id", "_choice").orderBy(F.desc("_sure"), "al_no"))
    wants = rows.where("_order is not null").select("cmp_id", "section_id_a", (turn == 1).alias("_moved"))
    rows = cut(rows.join(wants, ["cmp_id", "section_id_a"], "left").withColumn("_moved", F.coalesce("_moved", F.lit(False))))
    gone = rows.where("_moved").select("cmp_id", F.col("_choice").alias("section_id_b"))
    orphans = rows.where("(_split or _moved) and section_id_b is not null").select("cmp_id", "section_id_b", "order_b")
    orphans = orphans.select("cmp_id", F.lit("ADDED").alias("status"), F.lit(None).cast("string").alias("section_id_a"), "section_id_b", F.lit(None).cast("int").alias("order_a"), "order_b", F.lit(1.0).alias("confidence"), F.lit(None).cast(alignments.schema["signals"].dataType).alias("signals"))
    kept = rows.withColumn("status", F.when(F.col("_split"), "REMOVED").when(F.col("_moved"), "MATCHED").otherwise(F.col("status")))
    kept = kept.withColumn("confidence", F.when(F.col("_moved"), F.greatest("confidence", "_sure")).otherwise(F.col("confidence")))
    for c, new in (("section_id_b", "_choice"), ("order_b", "_order")):
        kept = kept.withColumn(c, F.when(F.col("_moved"), F.col(new)).when(~F.col("_split"), F.col(c)))
    stays = kept.where("status != 'ADDED'").unionByName(kept.where("status = 'ADDED'").join(gone, ["cmp_id", "section_id_b"], "left_anti"))
    order = Window.partitionBy("cmp_id").orderBy(F.coalesce("order_a", "order_b"), F.col("order_a").isNull())
    return stays.select(orphans.columns).unionByName(orphans).withColumn("al_no", F.row_number().over(order)).select(*alignments.columns)
