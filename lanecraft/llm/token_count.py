"""Token counts by overlap resynchronisation.

A text up to ``chunk_chars`` is encoded in one call.  A longer one is encoded in overlapping chunks with
offsets; neighbouring chunks are spliced at a *stable boundary* inside their overlap, and the overlap is
doubled when it holds none.

A boundary between the characters a and b is stable if no piece of the vocabulary contains "ab": a BPE
merge only ever builds pieces of the vocabulary, so no token can span the boundary whatever the rest of
the text is, and the two sides are encoded independently.  (Space counts as U+2581, the model's own mark;
the model's normaliser must be the identity, which ``stable_pairs`` checks.)

Null text counts as empty (0 bytes, 0 tokens).  Rows are independent: repeated rows give repeated results,
an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lanecraft.llm.common import grouped

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
MARK = "▁"


@functools.lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, stable_pairs(model)


def stable_pairs(model) -> frozenset[str]:
    """All adjacent character pairs inside vocabulary pieces; any other pair is a stable boundary."""
    probe = "ﬁ  ½ é"
    if "".join(model.encode(probe, out_type=str)).replace(MARK, " ") != " " + probe:
        raise ValueError("the model's normaliser rewrites text; boundaries can't be proven stable")
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return frozenset(p[i:i + 2] for p in pieces for i in range(len(p) - 1))


def boundary(text: str, lo: int, hi: int, inner: frozenset[str]) -> int | None:
    """The first stable boundary p with lo <= p < hi (between text[p-1] and text[p])."""
    marked = text[max(0, lo - 1):hi + 1].replace(" ", MARK)
    base = max(0, lo - 1)
    for p in range(max(1, lo), min(hi, len(text) - 1) + 1):
        if marked[p - 1 - base:p + 1 - base] not in inner:
            return p
    return None


def count_tokens(text: str, model, inner: frozenset[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Number of tokens of the whole text, as ``len(model.encode(text))``."""
    if len(text) <= chunk:
        return len(model.encode(text))
    total, start = 0, 0  # `start` is 0 or a stable boundary
    while start < len(text):
        end, wide = start + chunk, overlap
        cut, low = None, end  # no boundary from `low` to `end`; every place is looked at once
        while end < len(text) and cut is None:
            if low > start + 1:
                lo = max(start + 1, low - wide)
                cut = boundary(text, lo, low, inner)
                low, wide = lo, wide * 2
            else:  # nothing in the whole chunk: a longer chunk
                further = min(len(text), end + chunk)
                cut = boundary(text, end, further, inner) if further < len(text) else None
                end = further
        stop = len(text) if cut is None else cut
        # the chunk runs past the splice point, into the next chunk, and starts before its own
        lead = max(0, start - overlap) if start else 0
        tail = min(len(text), stop + overlap)
        total += _between(model, text[lead:tail], start - lead, stop - lead)
        start = stop
    return total


def _between(model, piece: str, lo: int, hi: int) -> int:
    """Tokens of the encoded chunk that lie in [lo, hi); both ends must be token boundaries."""
    # offsets are UTF-8 bytes; all but the last byte token of a character are empty and sit at its begin
    begins = [t.begin for t in model.encode(piece, return_type="proto").pieces]
    a, b = len(piece[:lo].encode()), len(piece[:hi].encode())
    if (a and a not in begins) or (hi < len(piece) and b not in begins):
        raise AssertionError("a stable boundary lies inside a token")
    # the model's own leading mark sits at 0: it counts for the text's start and is in the dropped lead elsewhere
    return sum(a <= x < b for x in begins)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
                 chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        model, inner = _model(model_path)
        for batch in grouped(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            counts = [0] * len(texts)
            for i, ids in zip(short, model.encode([texts[i] for i in short], num_threads=1) if short else []):
                counts[i] = len(ids)
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    counts[i] = count_tokens(t, model, inner, chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    sizes = docs.select(F.struct(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n")).alias("id"),
                        F.col(text_col).alias("text"))
    out = sizes.mapInArrow(run, f"id struct<id:{kind.simpleString()},n:bigint>, n_tokens bigint")
    return out.select(F.col("id.id").alias(id_col), F.col("id.n").alias("n_bytes"), "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))
