"""Token counts: batches of texts balanced by bytes are encoded in an Arrow function that returns lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import slices

#: Bytes of text that one call of the encoder gets.
BATCH_BYTES = 256 << 10
#: Texts of more characters than this are split.
PIECE_CHARS = 8 << 10

#: A single space between two characters that are neither white space nor the library's space mark.
_SAFE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    marked = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any("▁" in piece.lstrip("▁") for piece in marked):
        raise ValueError(f"{path}: a piece spans two words, so texts can't be split at spaces")
    if model.encode("a b", out_type=str) != model.encode("a", out_type=str) + model.encode("b", out_type=str):
        raise ValueError(f"{path}: a space between words isn't the same as the start of a text")
    return model


def pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """Parts of a text whose token counts add up to the text's own.

    No token spans a space between two words, and the model puts a space before every text, so the space at a cut is
    dropped. A text without such a space isn't cut.
    """
    out, start = [], 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.end()
    out.append(text[start:])
    return out


def _counted(model, texts: list[str]) -> list[int]:
    counts, parts, owners, held = [0] * len(texts), [], [], 0

    def flush():
        for i, ids in zip(owners, model.encode(parts, num_threads=1), strict=True):
            counts[i] += len(ids)

    for i, text in enumerate(texts):
        for part in pieces(text):
            parts.append(part)
            owners.append(i)
            held += len(part.encode())
            if held >= BATCH_BYTES:
                flush()
                parts, owners, held = [], [], 0
    flush()
    return counts


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens and over_limit (n_tokens > limit), without special tokens or truncation.

    Null texts count as empty: 0 bytes, 0 tokens. Ids may repeat or be null; other columns, whatever their names, are left out;
    an empty table gives no rows. A task holds the texts of one slice at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").fill_null("")
                counts = _counted(model, texts.to_pylist())
                sizes = pc.binary_length(texts).cast(pa.int64())
                over = pa.array([n > limit for n in counts], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("id"), sizes, pa.array(counts, pa.int64()), over], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return told.withColumnRenamed("id", id_col)
