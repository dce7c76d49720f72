"""SentencePiece encoding and decoding by a table of distinct marked words.

A text is the sequence of its words, each with the whitespace markers before
it. Where no piece of the model holds a marker behind another character, no
merge crosses the start of a marked word, so a word's pieces do not depend on
its neighbours: every distinct marked word is segmented once and its ids are
put back at all its positions.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.tables import map_texts, table

MARK = "▁"
# Distinct marked words a task keeps; beyond it the table starts anew, which costs time and changes nothing.
TABLE_WORDS = 300_000
MODEL = "piece_bpe_32k.model"


def public_model() -> str:
    """Place of the default model's file."""
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def words_stand_alone(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether marked words may be segmented one by one, as seen from the pieces and from a probe of the normaliser."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    probe = "  ﬁ①  x\t"
    return (
        not any(MARK in p.lstrip(MARK) for p in pieces)
        and model.decode(model.encode(probe)) == probe
        and model.encode("x", out_type=str)[0].startswith(MARK)
        and model.piece_to_id(MARK) != model.unk_id()
    )


class Encoder:
    """Ids of whole texts; the table of marked words lives as long as the task."""

    def __init__(self, model: bytes, limit: int = TABLE_WORDS):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.alone = words_stand_alone(self.model)
        self.limit = limit
        self.table: dict[str, list[int]] = {}
        self.split = re.compile(" +[^ ]*").findall

    def ids(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.alone:
            return self.model.encode(text, num_threads=1)
        # The model reads its mark as a space, and puts one mark before the text.
        marked = self.split(" " + text.replace(MARK, " "))
        missing = [w for w in dict.fromkeys(marked) if w not in self.table]
        if missing:
            if len(self.table) + len(missing) > self.limit:
                self.table.clear()
                missing = list(dict.fromkeys(marked))
            found = self.model.encode([w[1:] for w in missing], num_threads=1)
            self.table.update(zip(missing, found, strict=True))
            if " " in missing:  # a mark at the end of a text: alone it would be an empty text
                self.table[" "] = [self.model.piece_to_id(MARK)]
        return list(chain.from_iterable(map(self.table.__getitem__, marked)))


@cache
def _bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(
    docs: DataFrame, text: str = "text", model: str | None = None, end: bool = True, decoded: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """Columns ``keep`` (all) with ids (array of int) and, if wanted, the text decoded from them.

    The ids are those of the library on the whole text, with the end id behind
    them. A null text counts as empty: the end id alone, decoded as an empty
    text. Each task holds one table of marked words and one slice of texts;
    the model's file is read on the driver and sent along. Repeated rows are
    encoded each; there are no ties.
    """
    proto = _bytes(model or public_model())

    def begin():
        encoder = Encoder(proto)
        tail = [encoder.model.eos_id()] if end else []

        def work(texts: list, _) -> dict:
            rows, back = [], []
            for t in texts:
                ids = encoder.ids(t or "") + tail
                rows.append(pa.array(ids, pa.int32()))
                if decoded:
                    back.append(encoder.model.decode(ids))
            lengths = [0, *(len(r) for r in rows)]
            offsets = pa.compute.cumulative_sum(pa.array(lengths, pa.int32()))
            ids = pa.ListArray.from_arrays(offsets, pa.concat_arrays(rows) if rows else pa.array([], pa.int32()))
            return {"ids": ids, "decoded": back}

        return work

    added = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decoded
    return map_texts(docs, text, begin, T.StructType(added), docs.columns if keep is None else keep)


def decode(rows: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """``rows`` with the text decoded from their ids; null ids give a null text. A column decoded is replaced."""
    rows = rows.drop("decoded")
    proto = _bytes(model or public_model())
    fields = [*rows.schema.fields, T.StructField("decoded", T.StringType())]
    at = rows.columns.index(ids)

    def run(batches):
        back = sentencepiece.SentencePieceProcessor(model_proto=proto).decode
        for batch in batches:
            texts = [None if x is None else back(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def token_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id with the number of ids and digests of the ids and of the text decoded from them."""
    made = encode(docs, text, decoded=True, keep=["doc_id"])
    written = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded."""
    return token_digests(table(spark, folder, "documents"))
