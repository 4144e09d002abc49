"""Text functions as Column expressions; Arrow functions only where Unicode decomposition or nesting needs them."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.vocab import INTENT_KEYWORDS, STOP_WORDS, THEME_CATEGORIES


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _arrow(f: Callable[[str], object], kind: str):
    """An Arrow function of one string column; nulls stay null. Made on the driver only, so tasks can import this module."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return F.pandas_udf(each, kind)


def strings(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def significant_terms(text: Column | str, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Distinct words of more than three letters that aren't stop words, in order of appearance."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}']+)"), F.lit(1))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 3)), strings(stop))


def proper_nouns(text: Column | str, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Distinct capitalised words of three letters or more, lower-cased; edges of words are ASCII edges."""
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    found = F.regexp_extract_all(text, F.lit(rf"(?=\p{{Lu}}){edge}(\p{{Lu}}\p{{L}}{{2,}}){edge}"), F.lit(1))  # capitals first, as most places aren't one
    return F.array_except(F.array_distinct(F.transform(found, F.lower)), strings(stop))


def quotation_words(text: Column | str) -> Column:
    """Words as quotations are compared: bracketed notes dropped, lower case, letters, digits and apostrophes."""
    plain = F.translate(F.lower(F.regexp_replace(text, r"\[[^\]]*\]", " ")), "‘’", "''")
    return F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}']+)"), F.lit(1))


def ngrams(words: Column, n: int) -> Column:
    """Overlapping runs of n words as strings; none where there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def gram_hashes(hashes: Column, n: int) -> Column:
    """From a column of word hashes, a 64-bit hash of each overlapping run of n words; none where there are fewer."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))
    return F.when(F.size(hashes) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def contains_keyword(text: Column | str, keyword: str) -> Column:
    """Whether the text has the keyword as whole words, in any case; edges count only next to letters and digits."""
    left = r"(?<![A-Za-z0-9_])" if re.match(r"[A-Za-z0-9]", keyword) else ""
    right = r"(?![A-Za-z0-9_])" if re.search(r"[A-Za-z0-9]$", keyword) else ""
    return F.lower(text).rlike(left + re.escape(keyword.lower()) + right)


def theme_evidence(text: Column | str, keywords: Iterable[str], most: int = 3) -> Column:
    """The first sentences of more than 20 characters that hold a keyword as whole words."""
    sentences = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    held = lambda s: reduce(lambda x, y: x | y, [contains_keyword(s, k) for k in keywords], F.lit(False))
    return F.slice(F.filter(sentences, lambda s: (F.length(s) > 20) & held(s)), 1, most)


def query_key(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def alias_key(text: Column | str) -> Column:
    """A book's alias: lower case, dots and apostrophes dropped, other signs as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[.'’]", ""), r"[^\p{L}\p{N}]+", " "))


def passage_key(text_id, book, chapter, verse) -> Column:
    return F.concat_ws(":", text_id, book, col(chapter).cast("string"), col(verse).cast("string"))


def key_parts(key: Column | str) -> Column:
    parts = F.split(key, ":")
    return F.struct(parts[0].alias("text_id"), parts[1].alias("book"), parts[2].cast("int").alias("chapter"), parts[3].cast("int").alias("verse"))


def theme_category(theme: Column | str) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(THEME_CATEGORIES):
        out = F.when(col(theme).rlike(pattern), name).otherwise(out)
    return out


def intent(query: Column | str, keywords: dict[str, list[str]] = INTENT_KEYWORDS) -> Column:
    """The intent with the most keywords in the query (the first of equals) and its confidence; unknown and 0 without any."""
    key = query_key(query)
    counted = [F.struct(F.size(F.filter(strings(words), lambda w: F.contains(key, w))).alias("hits"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, words) in enumerate(keywords.items())]
    best = F.array_max(F.array(*counted))
    some = best["hits"] > 0
    return F.struct(F.when(some, best["name"]).otherwise("unknown").alias("intent"), F.when(some, F.least(F.lit(0.75), 0.35 + 0.2 * best["hits"])).otherwise(0.0).alias("confidence"))


def trigrams(word: Column) -> Column:
    """Trigrams of a lower-cased word with two spaces before and one after."""
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def word_similarity(query: str, words: Column) -> Column:
    """The best trigram similarity of the query to any of the words; 0 without words."""
    padded = f"  {query.lower()} "
    own = strings(sorted({padded[i : i + 3] for i in range(len(padded) - 2)}))
    each = F.transform(words, lambda w: F.size(F.array_intersect(trigrams(w), own)) / F.size(F.array_union(trigrams(w), own)))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def clean_translation(text: Column | str) -> Column:
    """Superscript footnotes, other tags and repeated white space removed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<sup[^>]*>.*?</sup>", ""), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def strip_usfm(text: Column | str) -> Column:
    """Marked-up scripture as plain text: notes dropped, attributes dropped, other markers dropped, in this order."""
    for pattern, new in ((r"\\(f|fe|x)\s.*?\\\1\*", ""), (r"\|[^\\]*", ""), (r"\\\+?[a-z]+\d*\*?", " "), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


_NOTE = re.compile(r"<(/?)(i|sup)\b([^>]*)>", re.IGNORECASE)


def without_footnotes(text: str) -> str:
    """Footnotes removed with what they enclose, however deep; line breaks as spaces, tags dropped, entities read."""
    out, at, depth = [], 0, 0
    for m in _NOTE.finditer(text):
        if depth == 0:
            out.append(text[at : m.start()])
            if not m[1] and "footnote" in m[3]:
                depth = 1
            else:
                out.append(m[0])
        else:
            depth += -1 if m[1] else 1
        at = m.end()
    if depth == 0:
        out.append(text[at:])
    bare = re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", "".join(out), flags=re.IGNORECASE))
    return re.sub(r"\s+", " ", html.unescape(bare)).strip()


def footnote_strip(text: Column | str) -> Column:
    return _arrow(without_footnotes, "string")(text)


# Letters that are written several ways fold to one.
_ALEF, _YEH, _HEH, _WAW = "\u0627", "\u064a", "\u0647", "\u0648"
_FOLDED = str.maketrans(
    {c: _ALEF for c in "\u0622\u0623\u0625\u0671\u0672\u0673\u0675"}
    | {c: _YEH for c in "\u0649\u0626"}
    | {"\u0629": _HEH, "\u0624": _WAW}
    | {"\u05da": "\u05db", "\u05dd": "\u05de", "\u05df": "\u05e0", "\u05e3": "\u05e4", "\u05e5": "\u05e6"}
)
_DAGGER, _HAMZA = "\u0670", "\u0621"
#: Combining marks, Hebrew points and signs, Arabic marks.
_DROPPED = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u0591-\u05c2\u05c4-\u05c7\u05f3\u05f4\u0640\u064b-\u065f\u0670\u06d6-\u06ed]")


def folded(text: str) -> str:
    """The text as search compares it: decomposed, an alif for a carrier with a dagger, no hamza, no marks or points, letter forms folded."""
    open_ = re.sub(f"[{_WAW}{_YEH}]{_DAGGER}", _ALEF, unicodedata.normalize("NFKD", text)).replace(_HAMZA, "")
    return re.sub(r"\s+", " ", _DROPPED.sub("", open_).translate(_FOLDED)).strip()


def readings(text: str) -> list[str]:
    """folded() of the text and, where a dagger alif may be a letter, the words that this reading has and the other hasn't."""
    plain = folded(text)
    if not plain:
        return []
    other = folded(text.replace(_DAGGER, _ALEF)) if _DAGGER in text else plain
    return [plain, *dict.fromkeys(w for w in other.split() if w not in plain)]


def fold(text: Column | str) -> Column:
    return _arrow(folded, "string")(text)


def search_readings(text: Column | str) -> Column:
    return _arrow(readings, "array<string>")(text)


def matches_reading(texts: Column, queries: Column) -> Column:
    """Whether any reading of a text holds any of a query, in any case."""
    return F.exists(texts, lambda t: F.exists(queries, lambda q: F.contains(F.lower(t), F.lower(q)) & (F.length(q) > 0)))


# Folded Greek words (final sigma written as sigma) whose forms no rule brings together, by stem.
GREEK_IRREGULAR = {
    "γυναικ": "γυνη γυναι γυναικοσ γυναικι γυναικα γυναικεσ γυναικων γυναιξι γυναιξιν γυναικασ",
    "ανδρ": "ανηρ ανερ ανδροσ ανδρι ανδρα ανδρεσ ανδρων ανδρασι ανδρασιν ανδρασ",
    "πατρ": "πατηρ πατερ πατροσ πατρι πατερα πατερεσ πατερων πατρασι πατρασιν πατερασ",
    "μητρ": "μητηρ μητερ μητροσ μητρι μητερα μητερεσ μητερων μητρασι μητρασιν μητερασ",
    "χειρ": "χειρ χειροσ χειρι χειρα χειρεσ χειρων χερσι χερσιν χειρασ",
    "υδατ": "υδωρ υδατοσ υδατι υδατα υδατων υδασι υδασιν",
    "φωτ": "φωσ φωτοσ φωτι φωτα φωτων",
    "παντ": "πασ πασα παν παντοσ παντι παντα παντεσ παντων πασι πασιν παντασ πασησ παση πασαν πασαι πασων πασαισ πασασ",
    "ειμ": "ειμι εστι εστιν εσμεν εστε εισι εισιν εσται εσονται ησαν",
}
#: Endings of adjectives of three genders, which middle participles have too.
_THREE = "οσ ου ω ον οι ουσ ων οισ η ησ ην αι αισ ασ α ε"
#: The stages that a Greek word goes through until one takes an ending off, by rules of this library: (what comes before the stem, endings).
GREEK_STAGES = (
    # participles: middle, then aorist passive and active by their stems in -nt, then feminine ones
    ("", [m + e for m in "ομεν αμεν ουμεν ωμεν".split() for e in _THREE.split()]),
    ("", [m + e for m in "θεντ σαντ οντ αντ ουντ ωντ εντ".split() for e in "οσ ι α εσ ων ασ".split()]),
    ("", [m + e for m in "θεισ ουσ ωσ".split() for e in "α ησ η αν αι ων αισ ασ".split() if m + e not in ("ωσα", "ωση", "ωσαι", "ωσων")] + ["θεισ"]),
    # infinitives
    ("", "σασθαι εσθαι ασθαι ουσθαι θηναι εναι ειν".split()),
    # past tenses, only behind an augment
    ("ε(?=[^αεηιουω])", "σαμεν σατε σασ σαν σεν σα σε θημεν θητε θησαν θην θησ θη".split()),
    # nouns in -ma, -is and -eus
    ("", "ματοσ ματι ματα ματων μασι μασιν μα εωσ εων εσι εσιν εα εασ ευσ ευσι ευσιν ευ".split()),
    # other nouns and adjectives, present tenses
    ("", (_THREE + " αν ει εισ εσ ι ιν ισ υ υν υσ εν ομεν ετε ουσι ουσιν ομαι εται ομεθα εσθε ονται").split()),
)
#: What is left of a word has two letters, one of them a vowel; the longest ending goes.
_GREEK = [f"^{before}(.*?(?:.[αεηιουω]|[αεηιουω].).*?)(?:{'|'.join(ends)})$" for before, ends in GREEK_STAGES]


def greek_stemmed(word: str) -> str:
    """The stem of a folded Greek word, by the first stage that takes an ending off it; other words, and shorter ones, as they are."""
    if len(word) < 3 or not re.search("[\u0370-\u03ff]", word):
        return word
    plain = word.lower().replace("ς", "σ")
    for stem, forms in GREEK_IRREGULAR.items():
        if plain in forms.split():
            return stem
    return next((m[1] for m in (re.search(p, plain) for p in _GREEK) if m), plain)


def greek_stem(word: Column) -> Column:
    """greek_stemmed() of a column."""
    plain = F.translate(F.lower(word), "ς", "σ")
    told = plain
    for pattern in reversed(_GREEK):
        told = F.when(plain.rlike(pattern), F.regexp_extract(plain, pattern, 1)).otherwise(told)
    for stem, forms in GREEK_IRREGULAR.items():
        told = F.when(plain.isin(forms.split()), stem).otherwise(told)
    return F.when((F.length(word) >= 3) & word.rlike("[\u0370-\u03ff]"), told).otherwise(word)


def stem_table(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, stem) of each distinct word of a column, so that the stages run once a word: to be joined with postings."""
    return words.select(F.col(word).alias("word")).where("word is not null").distinct().select("word", greek_stem(F.col("word")).alias("stem"))


def greek_words(words: Column) -> Column:
    return F.filter(words, lambda w: w.rlike("[\u0370-\u03ff]"))


def stemmed_tokens(words: Column) -> Column:
    """The Greek words of an array, stemmed."""
    return F.transform(greek_words(words), greek_stem)


def hebrew_word(word: Column | str) -> Column:
    """A Hebrew word without points, cantillation and other signs."""
    return F.regexp_replace(F.regexp_replace(word, "[\u0591-\u05c7]", ""), "[^\u05d0-\u05ea]", "")


def lexicon_candidate(word: Column | str) -> Column:
    return F.length(hebrew_word(word)) >= 2


def cross_lingual_tokens(text: Column | str, stop: Iterable[str] = ()) -> Column:
    """Tokens of three letters or more of the folded text that aren't stop words and aren't Latin."""
    tokens = F.split(fold(text), r"[^\p{L}\p{M}]+")
    return F.array_except(F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.rlike(r"\p{IsLatin}")), strings(stop))


class Phrases:
    """Phrases of one text that others may hold: runs of `least` to `most` of its words."""

    def __init__(self, text: str, least: int = 3, most: int = 8):
        self.text, self.least, self.most = text.lower(), least, most
        self.words = re.split(r"\s+", self.text)
        around: dict[str, set[tuple[str, str]]] = {}
        for before, middle, after in zip(self.words, self.words[1:], self.words[2:], strict=False):
            around.setdefault(middle, set()).add((before, after))
        # what stands before and after each word, as tuples for endswith() and startswith() too
        self.around = {m: (tuple({b for b, _ in p}), tuple({a for _, a in p}), tuple(p)) for m, p in around.items()}

    def held(self, theirs: str) -> set[tuple[str, str, str]]:
        """Those three words in a row of this text that the other, lower-cased text holds as a string, in one walk over its words.

        Of a held phrase the middle word is a word between single spaces there, its first ends one and its last begins one.
        """
        out, around, words = set(), self.around, theirs.split(" ")
        for i in range(1, len(words) - 1):
            known = around.get(words[i])
            if known is not None and words[i - 1].endswith(known[0]) and words[i + 1].startswith(known[1]):
                out.update((b, words[i], a) for b, a in known[2] if words[i - 1].endswith(b) and words[i + 1].startswith(a))
        return out

    def shared(self, other: str, limit: int = 8) -> list[str]:
        """The longest run at each word that the other text holds, then on behind it; the longest `limit` of them, each once."""
        theirs, out, i = other.lower(), {}, 0
        seeds = self.held(theirs) if self.least >= 3 else None
        while i <= len(self.words) - self.least and seeds != set():
            if seeds is not None and tuple(self.words[i : i + 3]) not in seeds:
                i += 1
                continue
            size, held = self.least, None
            while size <= min(self.most, len(self.words) - i):
                # a run is held only if its shorter ones are
                phrase = " ".join(self.words[i : i + size])
                if phrase not in theirs or phrase not in self.text:
                    break
                size, held = size + 1, phrase
            if held is not None:
                out[held] = True
            i += size - 1 if held is not None else 1
        return sorted(out, key=lambda p: -len(p))[:limit]


def shared_phrases(a: str, b: str, least: int = 3, most: int = 8) -> list[str]:
    """Phrases of a of `least` to `most` words that b holds, the longest first."""
    return Phrases(a, least, most).shared(b)


def shared_phrases_of(a: Column | str, b: Column | str) -> Column:
    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([shared_phrases(p or "", q or "") for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(each, "array<string>")(a, b)


def phrases_with(one: str, text: Column | str) -> Column:
    """The phrases of one given text that each text holds."""
    own = Phrases(one)

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: own.shared(t or ""))

    # else a filter on the phrases would be pushed below, and find them a second time
    return F.pandas_udf(each, "array<string>").asNondeterministic()(text)


def lexemes(vector: Column | str) -> Column:
    """A text vector like "'word':3,7 'other':1" as a map of words to their first places; of a repeated word the last entry counts."""
    entry = r"'([^']+)':(\d+)"
    keys, places = (F.regexp_extract_all(vector, F.lit(entry), F.lit(i)) for i in (1, 2))
    last = lambda k: F.get(F.reverse(places), F.array_position(F.reverse(keys), k).cast("int") - 1).cast("int")
    return F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k, last(k))))


def identity(cookie: Column | str) -> Column:
    """(user_id, is_new): the cookie where it is a UUID, else a new one."""
    known = F.coalesce(col(cookie).rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))
    return F.struct(F.when(known, col(cookie)).otherwise(F.uuid()).alias("user_id"), (~known).alias("is_new"))


# Words of themes that count as doctrine.
DOCTRINAL = "salvation|redemption|covenant|law|messiah|judgment|forgiveness|mercy|atonement|resurrection|sin"


def doctrinal(theme: Column) -> Column:
    return theme.rlike(DOCTRINAL)


def highlighted(text: str, phrases: Iterable[str], least: int = 4) -> list[dict]:
    """The text in parts, with whether each is one of the phrases, in any case: long phrases first, short ones left out, neighbours of one kind joined."""
    wanted = sorted({p.strip() for p in phrases if len(p.strip()) >= least}, key=lambda p: (-len(p), p))
    out: list[dict] = []

    def add(part: str, mark: bool) -> None:
        if part and out and out[-1]["highlighted"] == mark:
            out[-1]["text"] += part
        elif part:
            out.append({"text": part, "highlighted": mark})

    at = 0
    for m in re.finditer("|".join(map(re.escape, wanted)), text, re.IGNORECASE) if wanted else ():
        add(text[at : m.start()], False)
        add(m[0], True)
        at = m.end()
    add(text[at:], False)
    return out


def highlights(text: Column | str, phrases: Iterable[str], least: int = 4) -> Column:
    own = list(phrases)
    return _arrow(lambda t: highlighted(t, own, least), "array<struct<text:string,highlighted:boolean>>")(text)


def chunks(text: str, limit: int = 220) -> list[str]:
    """The text in parts of at most `limit` characters: cut behind sentences, else commas, else words, else anywhere."""
    out, rest = [], text.strip()
    while len(rest) > limit:
        head = rest[:limit]
        cut = max((m.end() for m in re.finditer(r"[.!?;:]\s", head)), default=0) or max((m.end() for m in re.finditer(r",\s", head)), default=0) or head.rfind(" ") + 1 or limit
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    return [c for c in [*out, rest] if c]


def speech_chunks(text: Column | str) -> Column:
    return _arrow(chunks, "array<string>")(text)


def highlight(text: Column | str, phrase: str, radius: int = 90) -> Column:
    """Where the phrase is (from 1, 0 if nowhere) and the text around it, with dots where it was cut."""
    at = F.locate(phrase.lower(), F.lower(text))
    start = F.greatest(at - radius, F.lit(1))
    end = F.least(at + len(phrase) - 1 + radius, F.length(text))
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.length(text), "…").otherwise(""))
    return F.struct(at.alias("at"), F.when(at > 0, cut).alias("snippet"))
