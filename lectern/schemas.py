"""Explicit schemas of the corpus tables; readers fail on rows that don't fit."""

from __future__ import annotations

PASSAGES = "id string, passage_key string, text_id string, book_slug string, chapter_num int, verse_num int, original_text string, primary_translation string, language string, verse_order int"
TRANSLATIONS = "id string, text_id string, name string, language string, translator string, year int, is_primary boolean"
PASSAGE_TRANSLATIONS = "passage_id string, translation_id string, text string, verified_at timestamp"
PASSAGE_THEMES = "passage_id string, theme_id string, score double, confidence double, evidence array<string>, source string"
EDGES = "source string, target string, type string, strength double, direction string, detected_by string"
LOGS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: A page of a paged source, with nested translations.
PAGED_JSON = "chapter long, verses array<struct<verse_number:long,text:string,translations:array<struct<resource_id:long,text:string>>>>, pagination struct<current_page:int,total_pages:int>"
#: All books of one file, in their order.
BULK_JSON = "array<struct<abbrev:string,name:string,chapters:array<array<string>>>>"
#: Chapters with a verse list for the original and one for the translation.
PARALLEL_JSON = "book string, chapter int, original array<string>, translation array<string>"
EDITION_JSON = "hadiths array<struct<hadithnumber:int,text:string,reference:struct<book:int,hadith:int>>>"
