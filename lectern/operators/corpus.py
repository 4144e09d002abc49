"""Views of the corpus: reading, libraries, lexicon, caches and reports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.similarity import lexicon_rank, normalised_weights
from lectern.operators.relational import running


def clamped(limit: int | None, default: int = 20, least: int = 1, most: int = 100) -> int:
    """A request's limit within its bounds."""
    return min(most, max(least, int(limit if limit is not None else default)))


def chapter(passages: DataFrame, text_id: str, number: float, chapters: int) -> DataFrame:
    """The passages of one chapter; a number out of range is the nearest chapter."""
    place = max(1, min(chapters, int(number)))
    return passages.where((F.col("text_id") == text_id) & (F.col("chapter") == place)).withColumn("chapters", F.lit(chapters))


def random_row(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """One row, the same for the same seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(1)


def assembled(passages: DataFrame, themes: DataFrame, others: DataFrame) -> DataFrame:
    """Passages with their themes, strongest first, and their other translations (name, text) unlike the primary text."""
    by_theme = themes.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "theme", "score"))), lambda t: F.struct(t["theme"].alias("theme"), t["score"].alias("score"))).alias("themes"))
    by_name = others.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("name", F.col("text").alias("other")))).alias("alternatives"))
    both = passages.join(by_theme, "id", "left").join(by_name, "id", "left")
    return both.withColumn("alternatives", F.filter(F.coalesce("alternatives", F.array().cast("array<struct<name:string,other:string>>")), lambda a: F.trim(a["other"]) != F.trim(F.col("text"))))


def resolved(cached: DataFrame, fresh: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Cached values, and fresh ones where nothing is cached, with where each comes from."""
    new = fresh.join(cached.select(*keys), list(keys), "left_anti")
    return cached.select(*keys, value, F.lit("cached").alias("origin")).unionByName(new.select(*keys, value, F.lit("fresh").alias("origin")))


def first_answer(df: DataFrame, engines: Sequence[str], value: str = "answer") -> DataFrame:
    """The first engine's answer that isn't null, and its name."""
    name = F.coalesce(*[F.when(F.col(e).isNotNull(), F.lit(e)) for e in engines])
    return df.withColumns({value: F.coalesce(*engines), "source": name})


def lexicon(entries: DataFrame, words: DataFrame, marker: str = "__none__") -> DataFrame:
    """Entries (lookup_word, headword, priority, strong) of each word, best first; markers of words without an entry are left out."""
    found = words.join(entries, "lookup_word").where(F.col("headword") != marker)
    order = Window.partitionBy("lookup_word").orderBy(lexicon_rank(F.col("headword") == F.col("lookup_word"), F.col("priority"), F.col("strong")), "headword")
    return found.withColumn("rank", F.row_number().over(order))


def within_cap(costs: DataFrame, order: str, cap: float, by: str) -> DataFrame:
    """Requests that fit under a cap, in order (a unique key), for each `by`; the others are refused."""
    return running(costs, [by], [F.col(order)], "cost", "spent").withColumn("refused", F.col("spent") > cap)


def recall(hits: DataFrame, page: int = 20, reach: int = 200) -> DataFrame:
    """Per language: queries, found on the page, found behind it, and the share that is found at all; hits: (language, place or null)."""
    on, behind = F.count_if(F.col("place") <= page), F.count_if((F.col("place") > page) & (F.col("place") <= reach))
    return hits.groupBy("language").agg(F.count(F.lit(1)).alias("queries"), on.alias("on_page"), behind.alias("behind"), ((on + behind) / F.count(F.lit(1))).alias("recall"))


def recall_tiers(found: DataFrame, page: int = 20, reach: int = 200) -> DataFrame:
    """Per language of found (lang, term, truth, place): words asked, what a page shows of all that hold them, of those that fit a page, of the others, and within reach.

    `truth` is how many passages hold a word, `place` where a search for it shows one; a passage behind `reach` isn't in found.
    """
    term = found.groupBy("lang", "term").agg(F.first("truth").alias("truth"), F.count_if(F.col("place") <= page).alias("page"), F.count_if(F.col("place") <= reach).alias("deep"))
    total = lambda c, when=None: F.coalesce(F.sum(c if when is None else F.when(when, F.col(c))), F.lit(0)).cast("long")
    fits, fits_reach = F.col("truth") <= page, F.col("truth") <= reach
    columns = {"hits": total("page"), "truth": total("truth"), "within_hits": total("page", fits), "within_truth": total("truth", fits), "beyond_hits": total("page", ~fits), "reachable_hits": total("deep", fits_reach)}
    told = term.groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("terms"), *(v.alias(f"all_{k}") for k, v in columns.items()))
    return told.select("language", "terms", *(F.col(f"all_{k}").alias(k) for k in columns), (F.col("all_hits") / F.col("all_truth")).alias("recall"))


def book_readings(verses: DataFrame, translations: DataFrame, number: float, chapters: int) -> DataFrame:
    """Every book (text_id, book) opened at a chapter, the nearest to the number: its counts, the books before and behind, translations and verses.

    verses: doc_id, text_id, book, chapter. translations: text_id, name, primary; primary ones come first, then by name.
    """
    place = max(1, min(chapters, int(number)))
    books = verses.groupBy("text_id", "book").agg(F.count(F.lit(1)).alias("verses"), F.countDistinct("chapter").alias("chapters"), F.sort_array(F.collect_list(F.when(F.col("chapter") == place, F.col("doc_id")))).alias("ids"))
    line = Window.partitionBy("text_id").orderBy("book")  # a text's books, a few dozen
    named = translations.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("primary")).alias("later"), "name"))).alias("t"))
    told = books.withColumns({"previous": F.lag("book").over(line), "next": F.lead("book").over(line)}).join(named, "text_id", "left")
    names = F.array_join(F.transform(F.coalesce("t", F.array().cast("array<struct<later:boolean,name:string>>")), lambda t: t["name"]), ",")
    return told.select("text_id", "book", "chapters", "verses", "previous", "next", F.lit(place).alias("chapter"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("verse_ids"), names.alias("translations"))


def unverified(rows: DataFrame, translations: DataFrame) -> DataFrame:
    """(text_id, unverified): unverified rows by translation, then by the translation's text."""
    by_translation = rows.groupBy("translation").agg(F.count(F.lit(1)).alias("n"))
    return by_translation.join(translations, "translation").groupBy("text_id").agg(F.sum("n").alias("unverified"))


def on_ring(nodes: DataFrame, by: str, order: str, size: int = 640, node: int = 17, margin: int = 26, pull: float = 0.42) -> DataFrame:
    """Nodes of journeys on a ring, its radius by their number, and the control point of the chord to the next node (null for the last)."""
    line = Window.partitionBy(by).orderBy(order)  # a journey's nodes, 200 at most
    count = F.count(F.lit(1)).over(Window.partitionBy(by))
    share = F.when(count <= 2, 0.34).when(count <= 6, 0.58).otherwise(0.82)
    angle = (F.row_number().over(line) - 1) / count * 2 * F.pi() - F.pi() / 2
    centre, radius = size / 2, (size / 2 - node - margin) * share
    placed = nodes.withColumns({"x": centre + F.cos(angle) * radius, "y": centre + F.sin(angle) * radius})
    middle = lambda c: (F.col(c) + F.lead(c).over(line)) / 2
    return placed.withColumns({f"c{c}": middle(c) - pull * (middle(c) - centre) for c in ("x", "y")})


def stored_weights(preferences: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Weights of users, normalised; the defaults where all are 0."""
    default = normalised_weights(None)
    each = {d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(d), F.lit(0.0)))) for d in dimensions}
    total = sum(each.values(), F.lit(0.0))
    pick = lambda d: F.when(total == 0, default[d]).when(F.abs(total - 1) <= 0.001, each[d]).otherwise(each[d] / total)
    return preferences.select("user_id", *(pick(d).alias(d) for d in dimensions))


def share_url(keys: Column, base: str = "https://example.org/compare?keys=") -> Column:
    return F.concat(F.lit(base), F.array_join(F.transform(keys, F.url_encode), ","))


def shared_keys(url: Column | str) -> Column:
    """The keys of a share link, in either spelling of its parameter."""
    raw = F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("keys")), F.try_parse_url(url, F.lit("QUERY"), F.lit("compare")))
    return F.transform(F.split(raw, ","), F.url_decode)


def term_pattern(terms: Sequence[str]) -> str:
    """Any of the terms as whole words, the longest first."""
    return "|".join(rf"(?<![A-Za-z0-9_]){re.escape(t)}(?![A-Za-z0-9_])" for t in sorted(terms, key=lambda t: (-len(t), t)))


def segments(text: str | None, terms: Sequence[str]) -> list[dict]:
    """The text in parts, with whether each is one of the terms as whole words: longest terms first, no overlaps."""
    if not text:
        return []
    pattern = re.compile(term_pattern(terms), re.IGNORECASE)
    out, at = [], 0
    for m in pattern.finditer(text):
        if m.start() > at:
            out.append({"part": text[at : m.start()], "term": False})
        out.append({"part": m[0], "term": True})
        at = m.end()
    return [*out, {"part": text[at:], "term": False}] if at < len(text) else out


def marked(df: DataFrame, terms: Sequence[str], text_col: str = "text", out: str = "segments") -> DataFrame:
    """df with its text in segments(); the terms are an argument, so few."""
    own = list(terms)

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: segments(t, own))

    return df.withColumn(out, F.pandas_udf(each, "array<struct<part:string,term:boolean>>")(text_col))


def voice_score(language: Column, wanted: Column, local: Column, default: Column) -> Column:
    """How well a voice fits a wanted language tag: the same tag, else the same language, else as the default voice at most."""
    voice, want = (F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit("-")) for c in (language, wanted))
    base = lambda tag: F.split(tag, "-")[0]
    bonus = lambda on, yes, no: F.when(on, yes).otherwise(no)
    near = (base(voice) != "") & (base(voice) == base(want))
    score = F.when(want == "", bonus(default, 1.0, 0.0)).when(voice == want, bonus(local, 40.0, 20.0) + bonus(default, 5.0, 0.0))
    return score.when(near, bonus(local, 15.0, 8.0) + bonus(default, 2.0, 0.0)).otherwise(bonus(default, 0.5, -1.0))


#: Bounds of what a request may ask, as (least, most).
REQUEST_BOUNDS = {"limit": (1, 100), "query": (1, 500), "batch": (1, 50), "per_group": (1, 20), "bar": (0.0, 1.0), "per": (1, 10)}
#: The most journeys of a user, nodes of a journey, characters of a name and of a note.
JOURNEY_LIMITS = {"journeys": 40, "nodes": 200, "name": 80, "note": 2000}


def bounded(value: Column, what: str) -> Column:
    """A request's number within its bounds."""
    least, most = REQUEST_BOUNDS[what]
    return F.greatest(F.lit(least), F.least(F.lit(most), value))


def journey_faults(nodes: DataFrame, user: str, asking: Column) -> DataFrame:
    """(journey, faults) of nodes (journey, owner, name, note): what a journey breaks of JOURNEY_LIMITS, and whether `asking` may change it."""
    own = nodes.groupBy("journey", user).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("name")).alias("name"), F.max(F.length("note")).alias("note"))
    held = own.groupBy(user).agg(F.countDistinct("journey").alias("journeys"))
    told = own.join(held, user)
    most = JOURNEY_LIMITS
    faults = [F.when(F.col("journeys") > most["journeys"], "journeys"), F.when(F.col("n") > most["nodes"], "nodes"), F.when(F.col("name") > most["name"], "name"), F.when(F.col("note") > most["note"], "note"), F.when(F.col(user) != asking, "owner")]
    return told.select("journey", user, F.array_compact(F.array(*faults)).alias("faults"))


def indexed(scores: DataFrame, needs: DataFrame, density: Mapping[str, float] | None = None) -> DataFrame:
    """Per passage: themes, whether a judge should look, and its density (.5 without a judge)."""
    counted = scores.groupBy("id").agg(F.count(F.lit(1)).alias("themes"), F.max("score").alias("top"))
    return needs.join(counted, "id", "left").select("id", F.coalesce("themes", F.lit(0)).cast("long").alias("themes"), "top", "needs", F.lit((density or {}).get("default", 0.5)).alias("density"))
