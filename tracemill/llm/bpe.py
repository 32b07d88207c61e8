"""BPE encoding and decoding of whole texts; long texts are encoded in parts and joined."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import flat, text_pieces
from .units import Encoder, byte_chars, tokenizer

#: Bytes of a text beyond which it is encoded in parts, and characters of a part.
LONG_TEXT, PART = 65_536, 32_768
#: Bytes of texts that are encoded at once.
PIECE = 2 << 20
#: Characters of one class on either side of a cut that is no boundary between tokens.
MARGIN = 2_048

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=4)
def encoder(name: str, lower: bool = False) -> Encoder:
    return Encoder(name, lower)


@lru_cache(maxsize=4)
def tables(name: str) -> tuple[pa.LargeBinaryArray, pa.LargeBinaryArray]:
    """For each id the bytes that it stands for, and its decimal digits with a comma."""
    tok, back = tokenizer(name), {c: b for b, c in byte_chars().items()}
    vocab = tok.get_vocab(with_added_tokens=True)
    known: list[bytes] = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        known[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return pa.array(known, pa.large_binary()), pa.array([b"%d," % i for i in range(len(known))], pa.large_binary())


def _kind(c: str) -> str:
    return "S" if c.isspace() else k if (k := unicodedata.category(c)[0]) in "LN" else "P"


def _boundary(text: str, i: int, special: str) -> bool:
    """True if no token spans text[i - 1] and text[i], whatever stands around them."""
    a, b = text[i - 1], text[i]
    x, y = _kind(a), _kind(b)
    return x != y and x != "S" and a != "'" and special not in text[max(0, i - len(special) + 1) : i + len(special) - 1]


def parts(text: str, size: int = PART, margin: int = MARGIN, special: str = "<|endoftext|>") -> list[tuple[bool, str]]:
    """The text in parts of about `size` characters, each with whether it begins within a run of one class of
    characters, where no boundary between tokens was near."""
    out, start, hard = [], 0, False
    while len(text) - start > size + 2 * margin:
        at = start + size
        cut = next((i for i in range(at, at + 2 * margin) if _boundary(text, i, special)), None)
        out.append((hard, text[start : cut or at + margin]))
        start, hard = cut or at + margin, cut is None
    return [*out, (hard, text[start:])]


def join_two(left: np.ndarray, right: np.ndarray, name: str, margin: int = MARGIN) -> np.ndarray:
    """Ids of the text of `left` followed by that of `right`, whose join lies within a run of one class.

    A window of tokens around the join is encoded again, and grows until its first token is the left side's and its
    last the right side's own: every pair of neighbours then is one that the tokenizer makes, so the whole is too.
    """
    known = tables(name)[0]
    k = 8
    while k <= min(len(left), len(right)):
        data = [b"".join(known[int(i)].as_py() for i in side) for side in (left[-k:], right[:k])]
        if max(map(len, data)) > margin // 2:
            break
        if data[0][0] & 0xC0 != 0x80 and (k == len(right) or known[int(right[k])].as_py()[0] & 0xC0 != 0x80):
            window = np.frombuffer(encoder(name).whole([b"".join(data).decode()])[0], np.uint32)
            if len(window) and window[0] == left[-k] and window[-1] == right[k - 1]:
                return np.concatenate((left[:-k], window, right[k:]))
        k += 8
    text = b"".join(known[int(i)].as_py() for i in np.concatenate((left, right)))
    return np.frombuffer(encoder(name).whole([text.decode()])[0], np.uint32)


def join_all(sides: list[tuple[bool, np.ndarray]], name: str, margin: int = MARGIN) -> np.ndarray:
    """Joins neighbours pairwise, as a tree."""
    while len(sides) > 1:
        sides = [
            (a[0], (join_two(a[1], b[0][1], name, margin) if b[0][0] else np.concatenate((a[1], b[0][1]))) if b else a[1])
            for a, b in ((sides[i], sides[i + 1 : i + 2]) for i in range(0, len(sides), 2))
        ]
    return sides[0][1] if sides else np.zeros(0, np.uint32)


def digests(ids: np.ndarray, begin: np.ndarray, name: str) -> tuple[list[str], list[str]]:
    """Of each text's ids and of the bytes that they decode to."""
    known, decimal = tables(name)
    out = []
    for table, tail in ((decimal, 1), (known, 0)):
        data, at = flat(table.take(pa.array(ids)))
        view, at = memoryview(data), at[begin]
        out.append([hashlib.sha256(view[a : max(a, b - tail)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
    return out[0], out[1]


def encode_digest(docs: DataFrame, name: str = "byte_bpe_50k.json", long_text: int = LONG_TEXT, part: int = PART) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, as the tokenizer encodes it without adding
    special tokens and decodes it without skipping any. Null and empty texts have no tokens; each row gives a row, so
    repeated rows repeat; empty tables give none. Other columns are not read.

    Texts of up to `long_text` bytes are encoded where they are read. Longer ones are cut into parts that tasks share;
    parts are cut between tokens where such a place is near, and within a run of one class of characters otherwise.
    The join of two such parts is encoded again by `join_two`, pairwise as a tree.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def short(batches):
        for whole in batches:
            for batch, text in text_pieces(whole, PIECE):
                ids, begin, _ = encoder(name).encode(text)
                one, two = digests(ids, begin, name)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(begin)), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def cut(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(batch.num_rows):
                row += 1
                made = parts(batch.column("text")[i].as_py(), part)
                for j in range(0, len(made), 8):
                    some = made[j : j + 8]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("doc_id")[i].as_py()] * len(some), pa.int64()), pa.array([row] * len(some), pa.int64()), pa.array(range(j, j + len(some)), pa.int32()), pa.array([x[0] for x in some], pa.bool_()), pa.array([x[1] for x in some], pa.string())],
                        ["doc_id", "row", "n", "hard", "text"],
                    )

    def encoded(batches):
        for whole in batches:
            for batch, text in text_pieces(whole, PIECE):
                ids, begin, _ = encoder(name).encode(text)
                data = [ids[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "row", "n", "hard")] + [pa.array(data, pa.binary())], ["doc_id", "row", "n", "hard", "ids"])

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        ids = join_all([(h, np.frombuffer(x, np.uint32)) for h, x in zip(rows["hard"], rows["ids"], strict=True)], name)
        one, two = digests(ids, np.array([0, len(ids)]), name)
        return pd.DataFrame({"doc_id": pd.array(rows["doc_id"][:1], "Int64"), "n_tokens": [len(ids)], "ids_sha256": one, "decoded_sha256": two})

    is_long = F.octet_length("text") > long_text
    quick = source.filter(~is_long).mapInArrow(short, SCHEMA)
    slow = source.filter(is_long).mapInArrow(cut, "doc_id long, row long, n int, hard boolean, text string").repartition("row", "n")
    slow = slow.mapInArrow(encoded, "doc_id long, row long, n int, hard boolean, ids binary").groupBy("row").applyInPandas(joined, SCHEMA)
    return quick.unionByName(slow)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
