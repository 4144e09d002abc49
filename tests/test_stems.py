"""English stems against published pairs, Greek forms that meet one stem."""

from lectern.functions import text as X
from lectern.functions.stems import ENGLISH_STOP, with_stems

#: The published sample of the algorithm's vocabulary, and words that its description names.
SAMPLE = (
    "consign consigned:consign consigning:consign consignment:consign consist consisted:consist consistency:consist consistent:consist consistently:consist consisting:consist consists:consist consolation:consol "
    "consolations:consol consolatory:consolatori console:consol consoled:consol consoles:consol consolidate:consolid consolidated:consolid consolidating:consolid consoling:consol consolingly:consol consols:consol "
    "consonant:conson consort consorted:consort consorting:consort conspicuous:conspicu conspicuously:conspicu conspiracy:conspiraci conspirator:conspir conspirators:conspir conspire:conspir conspired:conspir conspiring:conspir "
    "constable:constabl constables:constabl constance:constanc constancy:constanc constant "
    "knack knackeries:knackeri knacks:knack knag knave knaves:knave knavish kneaded:knead kneading:knead knee kneel kneeled:kneel kneeling:kneel kneels:kneel knees:knee knell knelt knew knick knif knife knight "
    "knightly:knight knights:knight knit knits:knit knitted:knit knitting:knit knives:knive knob knobs:knob knock knocked:knock knocker knockers:knocker knocking:knock knocks:knock knopp knot knots:knot "
    "skies:sky dying:die news innings:inning proceeds:proceed generate:generat generalization:general communism:communism hoping:hope hopping:hop hoped:hope luxuriated:luxuri ties:tie cries:cri gas this gaps:gap kiwis:kiwi "
    "cry:cri by say dogs's:dog relational:relat digitizer:digit operator:oper feudalism:feudal hopefulness:hope formative:format electrical:electr adjustment:adjust adoption:adopt controlling:control roll probate:probat rate:rate cease:ceas "
    "commandment:command commandments:command agreed:agre feed bled sing a is bee ed youth boyish"
)
PAIRS = dict(p.split(":") if ":" in p else (p, p) for p in SAMPLE.split())


def test_published_stems(spark):
    words = spark.createDataFrame([(w, "x") for w in PAIRS] + [(None, "x"), ("", "x"), ("étiquettes", "x")], "word string, _other string")
    got = {r["word"]: r["stem"] for r in with_stems(words).collect()}
    assert {w: got[w] for w in PAIRS} == PAIRS
    assert got[None] is None and got[""] == "" and got["étiquettes"] == "étiquett"


def test_stems_are_columns_only(spark):
    plan = with_stems(spark.createDataFrame([("words",)], "word string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Eval" not in plan
    assert len(ENGLISH_STOP) == len(set(ENGLISH_STOP)) == 127


# Forms of one word each, and the stem where they meet.
GREEK_FORMS = {
    "λογ": "λόγος λόγου λόγῳ λόγον λόγε λόγοι λόγων λόγοις λόγους",
    "καρδι": "καρδία καρδίας καρδίᾳ καρδίαν καρδίαι καρδιῶν καρδίαις",
    "θαλασσ": "θάλασσα θαλάσσης θαλάσσῃ θάλασσαν",
    "πνευ": "πνεῦμα πνεύματος πνεύματι πνεύματα πνευμάτων πνεύμασιν",
    "πολ": "πόλις πόλεως πόλει πόλιν πόλεις πόλεων πόλεσιν",
    "βασιλ": "βασιλεύς βασιλέως βασιλεῖ βασιλέα βασιλεῖς βασιλέων βασιλεῦσιν βασιλέας βασιλεῦ",
    "λυ": "λύω λύεις λύει λύομεν λύετε λύουσι λύουσιν λύομαι λύεται λύονται λύειν λύεσθαι λυόμενος λυομένου λυόμεναι λύοντος λύοντες λύουσα ἔλυσα ἔλυσεν ἔλυσαν ἐλύθη ἐλύθησαν",
    "πιστευ": "πιστεύω πιστεύει πιστεύουσιν πιστεύοντες πιστεύειν ἐπίστευσα ἐπίστευσεν ἐπίστευσαν",
    "γυναικ": "γυνή γυναικός γυναῖκες γυναιξίν",
    "ανδρ": "ἀνήρ ἀνδρός ἄνδρα ἀνδράσιν",
    "πατρ": "πατήρ πατρός πατέρα πατέρων",
    "θε": "θεός θεοῦ θεῶν θεοῖς",
}


def test_greek_forms_meet_one_stem(spark):
    forms = [(X.folded(w), stem) for stem, all_ in GREEK_FORMS.items() for w in all_.split()]
    assert [(w, X.greek_stemmed(w)) for w, _ in forms] == forms
    table = X.stem_table(spark.createDataFrame([*forms, *forms, ("word", "word"), ("το", "το"), (None, None)], "word string, stem string"))
    assert sorted(map(tuple, table.collect())) == sorted({*forms, ("word", "word"), ("το", "το")})
    # a stem keeps two letters and a vowel; endings of a past tense need its augment
    assert [X.greek_stemmed(w) for w in ("ων", "νεα", "δοξα", "δοξησ", "ΛΟΓΟΣ", "")] == ["ων", "νε", "δοξ", "δοξ", "λογ", ""]


def test_greek_columns_stem_like_python(spark):
    from itertools import product

    words = ["".join(w) for w in product(("ε", "λ", "επ"), ("υσ", "ογ", "θε", "κρ"), ("", "σ", "ομεν", "θησ", "οντ", "ματ"), ("α", "οσ", "εων", "σεν", "ευσ", "ουσα", "αι"))]
    got = {r["word"]: r["stem"] for r in X.stem_table(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {w: X.greek_stemmed(w) for w in words}
