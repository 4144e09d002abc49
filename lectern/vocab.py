"""Fixed vocabularies and weights."""

from __future__ import annotations

# Stop words of the term signals.
STOP_WORDS = (
    "the and or but in on at to for of with by from as is was are were be been being have has had do does did will would "
    "could should may might must can this that these those a an his her its their our your my me he she it they we you i "
    "him them us unto upon shall said say says lord god thou thee ye"
).split()

# Intents by keyword, in order of precedence.
INTENT_KEYWORDS = {
    "comparison": ["compare", "comparison", "versus", "vs", "side by side", "difference", "differ", "contrast"],
    "cross_reference": ["cross reference", "cross-reference", "quoted", "quotation", "related", "parallel to", "referenced"],
    "thematic_study": ["theme", "thematic", "throughout", "across texts", "concept of", "idea of"],
    "linguistic_analysis": ["word", "etymology", "root", "hebrew", "arabic", "greek", "grammar", "term", "terminology"],
    "explanation": ["meaning", "means", "explain", "interpretation", "understand", "significance"],
    "reading": ["read", "full text", "chapter", "verse", "surah", "passage"],
}

# Default weights of the five dimensions.
DEFAULT_WEIGHTS = {"thematic": 0.3, "linguistic": 0.3, "historical": 0.0, "narrative": 0.3, "theological": 0.1}

# Theme categories by pattern, the first that matches.
THEME_CATEGORIES = [
    ("divine_attributes", "mercy|compassion|forgiveness|love|grace"),
    ("covenant_law", "covenant|law|command|obedience|sin|repent|atonement|sacrifice|purity|righteous"),
    ("salvation", "salvation|redemption|resurrection|judgment|heaven|hell|afterlife|messiah|kingdom|eternal"),
    ("practice", "prayer|worship|fast|pilgrimage|charity|alms|ritual|ceremony|sabbath|festival"),
    ("ethics", "patience|gratitude|trust|honesty|kindness|generosity|humility"),
    ("narrative", "adam|noah|abraham|moses|david|solomon|jesus|muhammad|prophet|angel|satan|creation"),
    ("community", "community|family|marriage|parenthood|neighbor|stranger|poor|orphan|widow|governance"),
    ("cosmology", "earth|light|darkness|water|fire|wind|star|animal|plant"),
]

#: Stand-in themes for the fixtures, whose invented text holds few real theme words.
FIXTURE_THEMES = {"linking": ["that", "with", "this"], "origin": ["from", "for"], "being": ["is", "was", "are"], "sein": ["die", "und", "der"]}
