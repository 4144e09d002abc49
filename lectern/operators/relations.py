"""Relations between passages: comparisons, citations, journeys, figures, recommendations, cross-lingual terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.similarity import alignment, composite, cosine, cross_reference, dimensions, explanation, jaccard, letters, local_affinity
from lectern.functions.text import cross_lingual_tokens, doctrinal, fold, folded, proper_nouns, shared_phrases_of, significant_terms, strings
from lectern.operators.relational import both_ways, interleaved, top_n
from lectern.vocab import DEFAULT_WEIGHTS


def signals(passages: DataFrame, themes: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", text_id: str = "source", language: str = "lang") -> DataFrame:
    """(id, text_id, language, terms, names, letters, themes): what passages are compared by. Computed once, reused by every measure."""
    own = passages.select(F.col(id_col).alias("id"), F.col(text_id).alias("text_id"), F.col(language).alias("language"), significant_terms(text_col).alias("terms"), proper_nouns(text_col).alias("names"), letters(text_col).alias("letters"))
    if themes is None:
        return own.withColumn("themes", F.array().cast("array<string>"))
    listed = themes.groupBy("id").agg(F.array_sort(F.collect_set("theme")).alias("themes"))
    return own.join(listed, "id", "left").withColumn("themes", F.coalesce("themes", F.array().cast("array<string>")))


def against(source: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with their similarity to one source passage (a single row): Jaccards, affinity and the five dimensions."""
    one = source.limit(1).select(*(F.col(c).alias(f"s_{c}") for c in ("id", "text_id", "language", "letters", "terms", "names", "themes")))
    both = candidates.crossJoin(F.broadcast(one)).where(F.col("id") != F.col("s_id"))  # one row
    same = F.col("text_id") == F.col("s_text_id")
    cognate = F.when(F.col("language") != F.col("s_language"), jaccard("letters", "s_letters")).otherwise(0.0)
    jaccards = {f"j_{c}": jaccard(c, f"s_{c}") for c in ("themes", "terms", "names")}
    shared = {f"n_{c}": F.size(F.array_intersect(c, f"s_{c}")) for c in ("themes", "terms")}
    both = both.select("id", "text_id", same.alias("same_text"), *(v.alias(k) for k, v in jaccards.items()), cognate.alias("cognate"), *(v.alias(k) for k, v in shared.items()))
    affinity = local_affinity(F.col("j_themes"), F.col("j_terms"), F.col("j_names"), F.col("same_text"))
    return both.withColumns({"affinity": affinity, **dimensions(F.col("j_themes"), F.col("j_terms"), F.col("j_names"), F.col("cognate"), F.col("same_text"))})


def cross_references(compared: DataFrame, least: float = 0.2, most: int = 8) -> DataFrame:
    """Derived cross-references of the source of against(): strength, type, place."""
    found = compared.withColumn("x", cross_reference(F.col("n_themes"), F.col("n_terms"), F.col("j_names"), ~F.col("same_text")))
    return found.select("id", "text_id", F.col("x.strength").alias("strength"), F.col("x.type").alias("type")).where(F.col("strength") >= least).orderBy(F.desc("strength"), "id").limit(most)


def recommended(compared: DataFrame, vectors: DataFrame | None = None, weights: Mapping[str, float] | None = None, pool: int = 60, limit: int = 25, least: float = 0.15) -> DataFrame:
    """Candidates of against() by a blend of affinity and vector cosine, dealt over texts, ranked by the weighted dimensions."""
    blend = compared if vectors is None else compared.join(vectors, "id", "left")
    blend = blend.withColumn("blend", F.col("affinity") if vectors is None else 0.7 * F.col("affinity") + 0.3 * F.coalesce("cosine", F.lit(0.0))).where("blend > 0")
    dealt = interleaved(blend, "text_id", [F.desc("blend"), F.col("id")], pool)
    names = ("thematic", "linguistic", "historical", "narrative", "theological")
    return dealt.withColumn("composite", composite({n: n for n in names}, weights)).where(F.col("composite") >= least).orderBy(F.desc("composite"), "id").limit(limit)


def vector_cosines(vectors: DataFrame, source_id, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cosine) of every other vector to one, never below 0."""
    one = vectors.where(F.col(id_col) == source_id).limit(1).select(F.col(vector_col).alias("s"))
    return vectors.where(F.col(id_col) != source_id).crossJoin(F.broadcast(one)).select(F.col(id_col).alias("id"), F.greatest(F.lit(0.0), cosine(vector_col, "s")).alias("cosine"))  # one row


def citations(edges: DataFrame, passages: DataFrame, most: int = 60) -> DataFrame:
    """Per passage and text on the other side: how many quotations, the strongest, and the other passages, in order."""
    own = both_ways(edges).withColumn("rank", F.row_number().over(Window.partitionBy("self").orderBy(F.desc("strength"), "other"))).where(F.col("rank") <= most)
    told = own.join(passages.select(F.col("doc_id").alias("other"), F.col("source").alias("text_id")), "other")
    return told.groupBy("self", "text_id").agg(F.count(F.lit(1)).alias("citations"), F.max("strength").alias("best"), F.array_join(F.array_sort(F.collect_list("other")), ",").alias("others"))


def journey_edges(families: Sequence[tuple[str, DataFrame]], nodes: DataFrame, most: int = 120) -> DataFrame:
    """One edge for each pair of a journey's nodes: the first family that has it, then the strongest; strongest edges first.

    families: (kind, edges with source, target, strength), in order of precedence.
    """
    parts = [e.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "strength", F.lit(kind).alias("kind"), F.lit(i).alias("family")) for i, (kind, e) in enumerate(families)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    ids = nodes.select("id").distinct()
    inside = whole.where("a < b").join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    best = inside.withColumn("_n", F.row_number().over(Window.partitionBy("a", "b").orderBy("family", F.desc("strength")))).where("_n = 1").drop("_n", "family")
    return best.orderBy(F.desc("strength"), "a", "b").limit(most)


def suggestions(edges: DataFrame, nodes: DataFrame, drawn: DataFrame, most: int = 12, pool: int = 60) -> DataFrame:
    """Outgoing cross-references of a journey's nodes whose pair isn't drawn yet."""
    out = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").orderBy(F.desc("strength"), "source", "target").limit(pool)
    pairs = out.withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")}).join(drawn.select("a", "b"), ["a", "b"], "left_anti")
    return pairs.groupBy("a", "b").agg(F.max("strength").alias("strength")).orderBy(F.desc("strength"), "a", "b").limit(most)


def related(kinds: Sequence[tuple[str, DataFrame, int]]) -> DataFrame:
    """(self, other, kind, strength): each other passage once, under the first kind that has it; each kind with its own cap."""
    parts = [d.select("self", "other", "strength", F.lit(kind).alias("kind"), F.lit(i).alias("family"), F.lit(most).alias("most")) for i, (kind, d, most) in enumerate(kinds)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    once = whole.withColumn("_n", F.row_number().over(Window.partitionBy("self", "other").orderBy("family", F.desc("strength")))).where("_n = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("self", "kind").orderBy(F.desc("strength"), "other"))).where("rank <= most").select("self", "other", "kind", "strength", "rank")


def figure_mentions(passages: DataFrame, figures: Mapping[str, Sequence[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, figure, form): figures whose folded forms a folded passage holds, under the first form that it has. The figures are an argument, so few."""
    rest = [c for c in passages.columns if c not in (id_col, text_col)]
    read = passages.withColumn("_folded", fold(text_col))
    form = lambda forms: reduce(lambda later, f: F.when(F.contains("_folded", F.lit(folded(f))), f).otherwise(later), reversed(forms), F.lit(None).cast("string"))
    each = [F.struct(F.lit(name).alias("figure"), form(forms).alias("form")) for name, forms in figures.items()]
    found = read.select(F.col(id_col).alias("id"), F.explode(F.filter(F.array(*each), lambda m: m["form"].isNotNull())).alias("m"), *rest)
    return found.select("id", "m.figure", "m.form", *rest)


def xlingual_terms(passages: DataFrame, labels: DataFrame, most_labels: int = 150, least_passages: int = 5, least_df: int = 8, least_specificity: float = 0.8, top: int = 3, token: Column | None = None, id_col: str = "doc_id", language: str = "lang") -> DataFrame:
    """(theme, language, term, in_passages, specificity): words that passages of a theme have and few other themes' passages do.

    labels: (id, theme, score). Of each theme the strongest passages count, of each language that has enough of them.
    Of terms with the same first four letters the most frequent stays.
    """
    strong = top_n(labels, ["theme"], [F.desc("score"), F.col("id")], most_labels).select("id", "theme")
    own = passages.select(F.col(id_col).alias("id"), F.col(language).alias("language"), F.explode(F.array_distinct(token if token is not None else cross_lingual_tokens("text"))).alias("term"))
    lit = passages.select(F.col(id_col).alias("id"), F.col(language).alias("language"))
    enough = strong.join(lit, "id").groupBy("theme", "language").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_passages)
    counted = strong.join(own, "id").join(enough.select("theme", "language"), ["theme", "language"], "left_semi").groupBy("theme", "language", "term").agg(F.count(F.lit(1)).alias("in_passages")).where(F.col("in_passages") >= least_df)
    spread = counted.groupBy("language", "term").agg(F.count(F.lit(1)).alias("themes"))
    told = counted.join(spread, ["language", "term"]).withColumn("specificity", 1 / F.col("themes")).where(F.col("specificity") >= least_specificity)
    stem = Window.partitionBy("theme", "language", F.substring("term", 1, 4)).orderBy(F.desc("in_passages"), "term")
    return top_n(told.withColumn("_n", F.row_number().over(stem)).where("_n = 1").drop("_n", "themes"), ["theme", "language"], [F.desc("in_passages"), F.col("term")], top)


# ---------------------------------------------------------------- around one passage


def neighbourhood(scores: DataFrame, source_id, per_text: int, most: int = 4, text: str = "source") -> DataFrame:
    """(id) of passages that share one of the strongest themes of a passage: the best `per_text` of each text.

    scores: (id, theme, score, rank) and the text. The passage's own themes are a few rows.
    """
    seeds = scores.where((F.col("id") == source_id) & (F.col("rank") <= most)).select("theme")
    near = scores.where(F.col("id") != source_id).join(F.broadcast(seeds), "theme")
    return top_n(near, [text], [F.desc("score"), F.col("theme"), F.col("id")], per_text).select("id").distinct()


def recommendations(compared: DataFrame, candidates: DataFrame, vectors: DataFrame, weights: Mapping[str, float] | None = None, limit: int = 10, shortlist: int = 12, least: float = 0.15) -> DataFrame:
    """The best of the candidates (id) by the weighted dimensions of against(), from a short list dealt over texts by affinity and vectors."""
    blend = compared.join(candidates.select("id").distinct(), "id", "left_semi").join(vectors, "id", "left")
    blend = blend.withColumn("blend", F.round(0.7 * F.col("affinity") + 0.3 * F.coalesce("cosine", F.lit(0.0)), 9)).where("blend > 0")
    dealt = interleaved(blend, "text_id", [F.desc("blend"), F.col("id")], max(shortlist, 2 * limit))
    own = dealt.withColumn("composite", F.round(composite({n: n for n in DEFAULT_WEIGHTS}, weights), 9))
    return own.where(F.col("composite") >= least).orderBy(F.desc("composite"), "id").limit(limit)


def evidence(source: DataFrame, other: DataFrame) -> DataFrame:
    """What two passages of signals(), a row each, have in common by dimension: id and an array for each dimension."""
    one = source.limit(1).select(*(F.col(c).alias(f"s_{c}") for c in ("text_id", "terms", "names", "themes")))
    both = other.crossJoin(F.broadcast(one))  # one row
    shared = lambda c: F.array_sort(F.array_intersect(c, f"s_{c}"))
    pair = F.concat(F.lit("Corpus pair only: "), F.col("s_text_id"), F.lit(" and "), F.col("text_id"), F.lit(". No claim about these two passages."))
    told = {
        "thematic": shared("themes"),
        "linguistic": F.slice(shared("terms"), 1, 10),
        "historical": F.when(F.col("text_id") == F.col("s_text_id"), F.array().cast("array<string>")).otherwise(F.array(pair)),
        "narrative": shared("names"),
        "theological": F.filter(shared("themes"), doctrinal),
    }
    return both.select("id", *(v.alias(k) for k, v in told.items()))


def summary(scores: Mapping[str, Column | str], weights: Mapping[str, float] | None = None) -> Column:
    """One sentence: the composite and the dimensions that contribute most to it."""
    percent = lambda v: F.concat(F.format_number(v * 100, 1), F.lit("%"))
    top = F.transform(explanation(scores, weights), lambda e: F.concat(e["dimension"], F.lit(" ("), percent(e["contribution"]), F.lit(")")))
    led = F.when(F.size(top) > 0, F.concat(F.lit(", led by "), F.array_join(top, ", "))).otherwise("")
    return F.concat(F.lit("Composite "), percent(composite(scores, weights)), led, F.lit("."))


def passage_journey(scores: DataFrame, source_id, most: int = 5, pool: int = 120, members: int = 8, text: str = "source", place: str = "lang") -> DataFrame:
    """(theme, source_score, id, text, score, rank, corpora, cross_text): where each of a passage's strongest themes leads.

    The pool is the best rows of all its themes together. Of a theme the best passage of each book comes first, those of
    other texts before the passage's own, and the rest fills up by score.
    """
    own = scores.where(F.col("id") == source_id)
    seeds = own.where(F.col("rank") <= most).select("theme", F.col("score").alias("source_score"), F.col(text).alias("own_text"))
    n = seeds.count()  # a few themes of one passage
    near = scores.where(F.col("id") != source_id).join(F.broadcast(seeds), "theme").orderBy(F.desc("score"), "theme", "id").limit(max(1, n) * pool)
    best = F.row_number().over(Window.partitionBy("theme", text, place).orderBy(F.desc("score"), "id"))
    same = F.when((F.col("best") == 1) & (F.col(text) == F.col("own_text")), 1).otherwise(0)
    order = [(F.col("best") > 1).cast("int"), same, F.desc("score"), F.col("id")]
    chosen = near.withColumn("best", best).withColumn("rank", F.row_number().over(Window.partitionBy("theme").orderBy(*order))).where(F.col("rank") <= members)
    groups = chosen.groupBy("theme").agg(F.countDistinct(text).alias("corpora"))
    return chosen.join(groups, "theme").select("theme", "source_score", "id", text, "score", "rank", "corpora", (F.col("corpora") > 1).alias("cross_text"))


def alignments(pairs: DataFrame) -> DataFrame:
    """Pairs with signals of both sides (a_*, b_*) and their shared phrases, with the type and strength of their alignment and notes."""
    longest = F.coalesce(F.array_max(F.transform("phrases", F.length)), F.lit(0))
    cognates = F.when(F.col("a_language") != F.col("b_language"), jaccard("a_letters", "b_letters")).otherwise(0.0)
    themes = F.array_sort(F.array_intersect("a_themes", "b_themes"))
    found = alignment(longest, jaccard("a_names", "b_names"), cognates, F.size(themes))
    n = F.size("phrases")
    notes = F.when(n == 0, "no shared phrasing detected").when(n == 1, "1 shared phrase").otherwise(F.concat(n.cast("string"), F.lit(" shared phrases")))
    return pairs.withColumns({"found": found, "shared_themes": themes}).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "found.type", "found.strength", "phrases", "shared_themes", notes.alias("notes"))


def comparison(passages: DataFrame, own: DataFrame, ids: Sequence, id_col: str = "doc_id", text_col: str = "text", least: float = 0.15) -> DataFrame:
    """All pairs of 2 to 8 passages, in the order asked, that are aligned well enough; `own` are their signals()."""
    if not 2 <= len(set(ids)) <= 8:
        raise ValueError("a comparison takes 2 to 8 passages")
    asked = list(dict.fromkeys(ids))
    place = F.array_position(F.array(*map(F.lit, asked)), F.col("id"))
    few = own.where(F.col("id").isin(asked)).join(passages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id").withColumn("place", place)
    side = lambda z: few.select(*(F.col(c).alias(f"{z}_{c}") for c in few.columns))
    pairs = side("a").join(side("b"), F.col("a_place") < F.col("b_place"))  # 28 pairs at most
    told = alignments(pairs.withColumn("phrases", shared_phrases_of("a_text", "b_text")))
    return told.where(F.col("strength") >= least)


def related_to(source_id, edges: DataFrame, scores: DataFrame, caps: tuple[int, int, int] = (6, 4, 6), pool: int = 40, text: str = "source", place: str = "lang") -> DataFrame:
    """(other, kind, strength, rank) around one passage: what quotes it, other relations, and passages of other texts that share a theme.

    edges: (source, target, strength, kind), of which parallels and duplicates are left out; verbatim are quotations. Of
    themes the best passage of each book counts, of the best three times as many as are shown. Each passage comes once,
    under the first kind that has it.
    """
    near = both_ways(edges).where((F.col("self") == source_id) & ~F.col("kind").isin("parallel", "duplicate")).orderBy(F.desc("strength"), "other").limit(40)
    own = scores.where(F.col("id") == source_id).select("theme", F.col(text).alias("own_text"))
    n = own.count()  # a few themes of one passage
    held = scores.join(F.broadcast(own), "theme").where((F.col("id") != source_id) & (F.col(text) != F.col("own_text"))).orderBy(F.desc("score"), "id", "theme").limit(max(1, n) * pool)
    best = top_n(held, [text, place], [F.desc("score"), F.col("id"), F.col("theme")], 1).orderBy(F.desc("score"), "id").limit(3 * caps[2])
    kinds = [("verbatim", near.where("kind = 'quotation'").select("other", "strength"), 0), ("relation", near.where("kind <> 'quotation'").select("other", "strength"), 1), ("theme", best.select(F.col("id").alias("other"), F.col("score").alias("strength")), 2)]
    whole = None
    for name, d, i in kinds:
        d = d.select("other", "strength", F.lit(name).alias("kind"), F.lit(i).alias("family"), F.lit(caps[i]).alias("most"))
        whole = d if whole is None else whole.unionByName(d)
    once = whole.withColumn("nth", F.row_number().over(Window.partitionBy("other").orderBy("family", F.desc("strength")))).where("nth = 1")
    order = Window.partitionBy("kind").orderBy(F.desc("strength"), "other")  # some 60 rows in all
    return once.withColumn("rank", F.row_number().over(order)).where("rank <= most").select("other", "kind", "strength", "rank")


def figure_detail(mentions: DataFrame, stance: Column, order: str = "id", text: str = "source") -> DataFrame:
    """(figure, text, mentions, forms, stance, total): per figure and text its forms in the order in which they first appear, and the first row's stance."""
    own = mentions.withColumn("stance", stance)
    forms = own.groupBy("figure", text, "form").agg(F.min(order).alias("at"), F.count(F.lit(1)).alias("n"))
    listed = forms.groupBy("figure", text).agg(F.sum("n").alias("mentions"), F.transform(F.array_sort(F.collect_list(F.struct("at", "form"))), lambda f: f["form"]).alias("forms"))
    first = own.groupBy("figure", text).agg(F.min_by("stance", order).alias("stance"))
    total = own.groupBy("figure").agg(F.count(F.lit(1)).alias("total"))
    return listed.join(first, ["figure", text]).join(total, "figure")
