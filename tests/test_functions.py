"""Text functions and similarities on literals."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import similarity as S
from lectern.functions import text as X
from lectern.operators.search import Query, parse


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_terms_and_names(spark):
    assert one(spark, X.significant_terms(F.lit("The LIGHT of Light, which was with them; can't 2024!"))) == ["light", "which", "can't", "2024"]
    assert one(spark, X.proper_nouns(F.lit("And Moses met Aaron, aMoses and Éva Al"))) == ["moses", "met"][:1] + ["aaron"]
    assert one(spark, X.quotation_words(F.lit("He said [1] ‘Go’ — now!"))) == ["he", "said", "'go'", "now"]
    assert one(spark, X.ngrams(F.array(*map(F.lit, "abc")), 2)) == ["a b", "b c"]
    assert one(spark, X.ngrams(F.array(F.lit("a")), 2)) == []


@pytest.mark.parametrize("text, keyword, found", [("The Lord's day", "lord", True), ("overlord", "lord", False), ("a day of rest.", "day of rest", True), ("C++ here", "c++", True), ("", "x", False)])
def test_keywords(spark, text, keyword, found):
    assert one(spark, X.contains_keyword(F.lit(text), keyword)) is found


def test_evidence_needs_long_sentences(spark):
    text = "Mercy! The mercy of the king was great. No such word in this one. Again mercy is what they asked for."
    assert one(spark, X.theme_evidence(F.lit(text), ["mercy"])) == ["The mercy of the king was great.", "Again mercy is what they asked for."]


def test_keys(spark):
    assert one(spark, X.query_key(F.lit("  A   b\tC "))) == "a b c"
    assert one(spark, X.alias_key(F.lit("1 St. John’s-Book"))) == "1 st johns book"
    assert one(spark, X.key_parts(F.lit("nt:john:3:16"))).asDict() == {"text_id": "nt", "book": "john", "chapter": 3, "verse": 16}
    assert one(spark, X.theme_category(F.lit("divine_mercy"))) == "divine_attributes" and one(spark, X.theme_category(F.lit("xyz"))) == "other"


def test_intents(spark):
    got = one(spark, X.intent(F.lit("Compare  the difference in meaning")))
    assert (got["intent"], got["confidence"]) == ("comparison", 0.75)
    assert one(spark, X.intent(F.lit("zzz")))["intent"] == "unknown"


def test_markup():
    assert X.without_footnotes('In the <sup class="footnote-marker">a</sup><i class="footnote">note <i>deep</i> end</i>beginning<br>was&nbsp;&#65;&#x42;') == "In the beginning was AB"
    assert X.without_footnotes("<i>kept</i> <b>bold</b>") == "kept bold"


def test_usfm_text(spark):
    text = r'In \w the|strong="H1"\w* beginning\f + \ft a note\f* was \nd God\nd*'
    assert one(spark, X.strip_usfm(F.lit(text))) == "In the beginning was God"


def test_scripts_fold(spark):
    assert X.folded("שָׁלוֹם") == X.folded("שלום") and X.folded("מֶלֶךְ") == "מלכ"
    assert X.folded("ٱلرَّحْمَٰنِ") == "الرحمن" and X.folded("λόγος") == "λογος"
    assert X.folded("ٱلرَّحْمَة") == X.folded("الرحمة") and X.folded("عَلَىٰ") == "علي" and X.folded("مُؤْمِن") == "مومن"
    assert X.folded("ٱلصَّلَوٰةَ") == "الصلاه" and X.folded("سُؤَال") == X.folded("سوال") and X.folded("ٱلْقُرْءَان") == "القران"
    assert X.folded("אֶרֶץ") == "ארצ" and X.folded("סֵפֶר") == "ספר" and X.folded("  a\t b ") == "a b"
    assert X.readings("ٱلرَّحْمَٰنِ") == ["الرحمن", "الرحمان"]
    assert one(spark, X.lexicon_candidate(F.lit("אָב"))) and not one(spark, X.lexicon_candidate(F.lit("a א")))
    read = spark.createDataFrame([("ٱلرَّحْمَٰنِ", "رحمان"), ("ٱلرَّحْمَٰنِ", "كتاب")], "t string, q string").select(X.search_readings("t").alias("t"), X.search_readings("q").alias("q"))
    assert [r[0] for r in read.select(X.matches_reading(F.col("t"), F.col("q"))).collect()] == [True, False]
    assert one(spark, X.cross_lingual_tokens(F.lit("λόγος ab abc του word"), ["του"])) == ["λογος"]


def test_shared_phrases():
    assert X.shared_phrases("in the beginning was the word and more", "so in the beginning was light, the word and more") == ["in the beginning was", "the word and more"]
    assert X.shared_phrases("a b", "a b") == []
    assert X.shared_phrases("one two three four", "One  two three four") == ["two three four"]  # texts are compared as they are written


def test_evidence_needs_whole_words(spark):
    text = "They spoke of reincarnation for many years.  Every nation on the earth has one!"
    assert one(spark, X.theme_evidence(F.lit(text), ["nation"])) == ["Every nation on the earth has one!"]


def test_greek_stems(spark):
    assert {X.greek_stemmed(X.folded(w)) for w in ("λόγος", "λόγον", "λόγου", "λόγῳ", "λόγοι")} == {"λογ"}
    assert X.greek_stemmed(X.folded("θεοῦ")) == X.greek_stemmed(X.folded("θεός")) == "θε" and X.greek_stemmed("word") == "word"
    assert one(spark, X.stemmed_tokens(F.array(F.lit("λογος"), F.lit("word"), F.lit("το")))) == ["λογ", "το"]


def test_vectors_of_lexemes(spark):
    assert one(spark, X.lexemes(F.lit("'merci':3,7 'lord':1 'merci':9"))) == {"merci": 9, "lord": 1}
    assert one(spark, X.lexemes(F.lit(""))) == {}


def test_identities(spark):
    own = "0a1B2c3d-0000-4000-8000-00000000000f"
    assert one(spark, X.identity(F.lit(own))).asDict() == {"user_id": own, "is_new": False}
    for bad in ("x" + own, "", None):
        got = one(spark, X.identity(F.lit(bad).cast("string")))
        assert got["is_new"] and len(got["user_id"]) == 36


def test_highlights_join_neighbours():
    assert X.highlighted("The Lord said unto him", ["lord said", "lord", "unto him", "him"]) == [{"text": "The ", "highlighted": False}, {"text": "Lord said", "highlighted": True}, {"text": " ", "highlighted": False}, {"text": "unto him", "highlighted": True}]
    assert X.highlighted("abcdabcd", ["abcd"]) == [{"text": "abcdabcd", "highlighted": True}] and X.highlighted("x", []) == [{"text": "x", "highlighted": False}] and X.highlighted("", ["abcd"]) == []


def test_doctrine(spark):
    assert one(spark, X.doctrinal(F.lit("divine_mercy"))) and not one(spark, X.doctrinal(F.lit("prayer")))


def test_chunks():
    text = "One sentence here. " * 30 + "x" * 500
    parts = X.chunks(text)
    assert all(len(p) <= 220 for p in parts) and "".join(parts).replace(" ", "") == text.replace(" ", "")


def test_highlight(spark):
    got = one(spark, X.highlight(F.lit("a" * 200 + " needle " + "b" * 200), "Needle", 10))
    assert got["at"] == 202 and got["snippet"] == "…" + "a" * 9 + " needle " + "b" * 9 + "…"
    assert one(spark, X.highlight(F.lit("none"), "needle"))["snippet"] is None


def test_word_similarity(spark):
    words = F.array(F.lit("mercy"), F.lit("king"))
    assert one(spark, X.word_similarity("mercy", words)) == 1.0 and 0 < one(spark, X.word_similarity("mercys", words)) < 1
    assert one(spark, X.word_similarity("x", F.array().cast("array<string>"))) == 0.0


def test_queries_parse():
    assert parse('mercy or grace -wrath "holy day" king') == Query([["mercy", "grace"], ["king"]], [["holy", "day"]], ["wrath"])
    assert parse("").terms == []


def test_similarity(spark):
    arr = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    vec = lambda *v: F.array(*map(F.lit, v)).cast("array<float>")
    assert one(spark, S.jaccard(arr("a", "b"), arr("b", "c"))) == pytest.approx(1 / 3) and one(spark, S.jaccard(arr(), arr("a"))) == 0
    assert one(spark, S.cosine(vec(1.0, 0.0), vec(1.0, 1.0))) == pytest.approx(0.5**0.5)
    assert one(spark, S.cosine(vec(1.0), vec(1.0, 1.0))) == 0 and one(spark, S.cosine(vec(0.0), vec(1.0))) == 0
    assert one(spark, S.scale(F.lit(0.3), 0, 0.6)) == pytest.approx(0.5) and one(spark, S.sigmoid(F.lit(-1000.0))) == 0
    assert one(spark, S.quotation_score(F.lit(6), F.lit(6))) == pytest.approx(0.3015) and one(spark, S.quotation_score(F.lit(16), F.lit(40))) == 1.0
    assert one(spark, S.verdict(F.lit(0.4))) == "addressed" and one(spark, S.verdict(F.lit(0.7))) == "partial" and one(spark, S.verdict(F.lit(0.8))) == "unaddressed"
    assert one(spark, S.alignment(F.lit(31), F.lit(1.0), F.lit(1.0), F.lit(3))).asDict() == {"type": "direct_quote", "strength": 0.85}
    assert one(spark, S.alignment(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0)))["type"] == "none"
    assert one(spark, S.relation_kind(F.lit("a"), F.lit("b"), F.lit("1:1"), F.lit("1:1"))) == "duplicate"


def test_weights():
    assert S.normalised_weights(None)["thematic"] == 0.3 and S.normalised_weights({"thematic": 0})["thematic"] == 0.3
    own = S.normalised_weights({"thematic": 2, "narrative": 0.5})
    assert own["thematic"] == pytest.approx(2 / 3) and sum(own.values()) == pytest.approx(1)


def test_vocabulary_has_all_terms_without_a_limit(spark):
    from lectern.operators import ml

    counts = spark.range(1_000_002).selectExpr("id", "cast(id AS string) AS term", "1L AS n")
    assert ml.vocabulary(counts, 1, None).count() == 1_000_002 and ml.vocabulary(counts, 1, 10).count() == 10
