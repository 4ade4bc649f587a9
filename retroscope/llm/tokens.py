"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_CHARS = 32_768
BATCH_BYTES = 1 << 20
LIMIT = 1024

# the start of a run of white space: \S of Python leaves out all that any tokeniser counts as white space
_SPACE_RUN = re.compile(r"(?<=\S)[ \t\r\n]")
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    """Number of tokens of each text, by the library of the vocabulary file; loaded once per worker."""
    if path not in _ENCODERS:
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
            _ENCODERS[path] = lambda texts: [len(e) for e in encode(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _ENCODERS[path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"no library for {path}")
    return _ENCODERS[path]


def safe_pieces(text: str, longest: int) -> list[str]:
    """Cut where a byte-level pre-tokeniser always cuts: before a run of white space that follows
    another character. A stretch without white space stays whole, however long."""
    if len(text) <= longest:
        return [text]
    pieces, start = [], 0
    while len(text) - start > longest:
        cut = _SPACE_RUN.search(text, start + longest)
        if cut is None:
            break
        pieces.append(text[start:cut.start()])
        start = cut.start()
    pieces.append(text[start:])
    return pieces


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", id: str = "doc_id", limit: int = LIMIT,
                 piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row, without any shuffle.

    Scan splits are even in bytes; inside a task texts are gathered into batches of about
    ``batch_bytes`` and long ones are cut at safe boundaries (byte-level .json vocabularies only), so
    a batch never holds many long texts. Null counts as empty (0 tokens); repeated rows are counted
    each; an empty table gives no rows; other columns are ignored. Special strings inside texts are
    handled as the library does by default; no token is added, dropped or padded.
    """
    cut = vocabulary.endswith(".json")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            sizes, totals = [0] * len(texts), [0] * len(texts)
            pending, owners, held = [], [], 0

            def flush():
                for i, n in zip(owners, encode(pending)):
                    totals[i] += n
                pending.clear()
                owners.clear()

            for i, t in enumerate(texts):
                sizes[i] = len(t.encode())
                for piece in safe_pieces(t, piece_chars) if cut else [t]:
                    if piece:
                        pending.append(piece)
                        owners.append(i)
                        held += len(piece.encode()) if len(piece) != len(t) else sizes[i]
                        if held >= batch_bytes:
                            flush()
                            held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
