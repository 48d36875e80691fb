"""Token ids as flat files of unsigned integers with 64-bit document offsets.

``write_token_files`` deals documents by range of their key, encodes each range in
order and writes, for range k, ``tokens-k.bin`` (16-bit unsigned integers where the
vocabulary allows it, else 32-bit), ``keys-k.bin`` (64-bit keys) and ``offsets-k.bin``
(64-bit: where each document begins among the tokens of the whole corpus, and the end).
A range's base is the prefix sum of the token counts before it.  Files are written
under another name and moved into place, so that a task that runs again, or twice at
once, leaves whole files.  ``read_documents`` and ``map_documents`` memory-map them.

Defined cases: a null text is encoded as an empty one, so it holds the end id alone; a
null key is stored as the least 64-bit integer and read as null; rows of one key stay
separate, in the order of the input; texts are encoded whole, whatever their length
(a special token's name in a text is read as that token, as the library does by default);
an empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import write_and_read

NULL_KEY = -(1 << 63)
CACHE_PIECES = 1_500_000
WORDS_AT_ONCE = 250
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def splits_at_spaces(model: str) -> bool:
    """Whether a single space between two other characters always begins a new piece.

    So it is with byte-level pre-tokenizing by its usual pattern: a run of other
    characters is never joined over a space, and a lone space goes to what follows.
    """
    spec = json.loads(model)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])) for t in spec.get("added_tokens", []))
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
        and plain
    )


class TextEncoder:
    """Texts to id arrays with the tokenizers library; whole texts, no special tokens added.

    Where the model allows it, a text is cut at lone spaces and each distinct piece is
    encoded once for many texts, which gives the ids of the whole text at a fraction of
    the time.  The first ``CACHE_PIECES`` pieces are kept; others are encoded anew for
    each batch, so memory is bounded.
    """

    def __init__(self, model: str, dtype: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        self.tokenizer, self.dtype = Tokenizer.from_str(model), np.dtype(dtype)
        self.by_piece, self.lone_space = splits_at_spaces(model), re.compile(r"(?<=\S) (?=\S)")
        self.known: dict[str, bytes] = {}
        # By id, whether a token begins with a space, which byte-level models write as Ġ.
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it, many words to one call: a space
        begins a piece, so the tokens that begin with one tell the words apart."""
        lines = [" " + " ".join(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        out: list[bytes] = []
        for i in range(0, len(lines), 100):
            for encoded in self.tokenizer.encode_batch_fast(lines[i : i + 100], add_special_tokens=False):
                ids = np.array(encoded.ids, self.dtype)
                ends = [*np.flatnonzero(self.begins[ids]).tolist(), len(ids)]
                flat, size = ids.tobytes(), self.dtype.itemsize
                out += [flat[a * size : b * size] for a, b in zip(ends, ends[1:])]
        if len(out) != len(words):
            raise RuntimeError("words and tokens that begin with a space do not agree")
        return out

    def raw(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 1000):
            encoded = self.tokenizer.encode_batch_fast(texts[i : i + 1000], add_special_tokens=False)
            ids = [e.ids for e in encoded]
            flat = np.fromiter(chain.from_iterable(ids), self.dtype).tobytes()
            ends = np.cumsum([0, *map(len, ids)]) * self.dtype.itemsize
            out += [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        return out

    def cut(self, text: str) -> list[str]:
        # A space beside white space, or white space of another kind, is left to the pattern.
        if "  " in text or " \n" in text or "\n " in text or any(c in text for c in OTHER_SPACE):
            return self.lone_space.split(text)
        first, *rest = text.split(" ")
        if rest and not (first and rest[-1]):  # a space at either end
            return self.lone_space.split(text)
        return [first, *rest]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self.raw(texts)
        cut = [self.cut(t) for t in texts]
        known, fresh = self.known, {}
        firsts = self.raw([c.pop(0) for c in cut])
        new = set(chain.from_iterable(cut)).difference(known)
        # Marks at the end of a word are pieces of their own.
        bare = {p: p.rstrip(".,;:!?") for p in new}
        bare = {p: b if b and b[-1].isalnum() else p for p, b in bare.items()}
        words = list(set(bare.values()).difference(known))
        # Pieces with a space inside or at the end are left to the pattern.
        odd = [w for w in words if " " in w or w[-1:].isspace()]
        words = list(set(words).difference(odd))
        fresh.update(zip(words, self.words(words)))
        fresh.update(zip(odd, self.raw([" " + w for w in odd])))
        marks = {p[len(b) :] for p, b in bare.items()} - {""}
        marked = dict(zip(marks, self.raw(list(marks))))
        of = lambda w: fresh[w] if w in fresh else known[w]
        fresh.update({p: of(b) + marked[p[len(b) :]] for p, b in bare.items() if len(b) < len(p)})
        if len(known) + len(fresh) <= CACHE_PIECES:
            known.update(fresh)
            lookup = known.__getitem__
        else:
            lookup = lambda w: known[w] if w in known else fresh[w]
        return [f + b"".join(map(lookup, c)) for f, c in zip(firsts, cut)]


def open_folder(folder: str):
    """The file system of a folder's address, and the folder's path in it."""
    from pyarrow import fs

    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def put_file(folder: str, name: str, parts) -> None:
    """Write ``parts`` (bytes-like) to a file, under another name until it is whole."""
    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    store.move(draft, f"{path}/{name}")


def get_array(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the folder is a local one, else read."""
    from pyarrow import fs

    store, path = open_folder(folder)
    if isinstance(store, fs.LocalFileSystem):
        full = f"{path}/{name}"
        return np.memmap(full, dtype, "r") if Path(full).stat().st_size else np.zeros(0, dtype)
    with store.open_input_file(f"{path}/{name}") as file:
        return np.frombuffer(file.readall(), dtype)


def slices(frames: Iterator[pd.DataFrame], characters: int = 2_000_000) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts, few enough at a time that their ids stay small."""
    for frame in frames:
        keys, texts, held = [], [], 0
        for key, text in zip(frame["__key"].array, frame["__text"].array):
            keys.append(key)
            texts.append(text)
            held += len(text)
            if held >= characters:
                yield keys, texts
                keys, texts, held = [], [], 0
        if keys:
            yield keys, texts


def write_token_files(
    docs: DataFrame, key: str, text: str, folder: str, model_path: str, end_id: int = 0
) -> DataFrame:
    """Write the files; the manifest: ``part``, ``folder``, ``dtype``, ``n_docs``, ``n_tokens``, ``base``."""
    spark = docs.sparkSession
    model = Path(model_path).read_text()
    spec = json.loads(model)
    largest = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    dtype = "<u2" if largest < 1 << 16 else "<u4"
    # The model file's size is that of a vocabulary, whatever the corpus.  A worker keeps the
    # broadcast value over its tasks, and with it the encoder.
    shared = spark.sparkContext.broadcast({"model": model})

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), shared.value
        if "encoder" not in held:
            held["encoder"] = TextEncoder(held["model"], dtype)
        encoder = held["encoder"]
        end = np.array([end_id], dtype).tobytes()
        keys: list[np.ndarray] = []
        lengths: list[int] = []

        def tokens():
            for batch_keys, texts in slices(frames):
                keys.append(np.array(batch_keys, dtype="<i8"))
                for ids in encoder.encode(texts):
                    lengths.append(len(ids) // len(end) + 1)
                    yield ids + end

        name = f"{part:06d}.bin"
        put_file(folder, f"tokens-{name}", tokens())
        put_file(folder, f"keys-{name}", keys)
        put_file(folder, f"lengths-{name}", [np.array(lengths, dtype="<i8")])
        yield pd.DataFrame({"part": [part], "n_docs": [len(lengths)], "n_tokens": [sum(lengths)]})

    placed = (
        docs.select(
            F.coalesce(F.col(key).cast("bigint"), F.lit(NULL_KEY)).alias("__key"),
            F.coalesce(F.col(text), F.lit("")).alias("__text"),
            F.monotonically_increasing_id().alias("__tie"),
        )
        .repartitionByRange("__key", "__tie")
        .sortWithinPartitions("__key", "__tie")
        .select("__key", "__text")
    )
    written = write_and_read(placed.mapInPandas(write, "part int, n_docs bigint, n_tokens bigint"), "token-parts")
    # One row for each range: their prefix sums are taken here.
    parts = sorted((r["part"], r["n_docs"], r["n_tokens"]) for r in written.filter("n_docs > 0").collect())
    base, rows = 0, []
    for part, n_docs, n_tokens in parts:
        rows.append((part, folder, dtype, n_docs, n_tokens, base))
        base += n_tokens
    schema = "part int, folder string, dtype string, n_docs bigint, n_tokens bigint, base bigint"
    manifest = spark.createDataFrame(rows, schema).repartition(max(1, len(rows)))

    def offsets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                lengths = get_array(r.folder, f"lengths-{r.part:06d}.bin", "<i8")
                starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8") + r.base
                put_file(r.folder, f"offsets-{r.part:06d}.bin", [starts])
            yield frame

    return write_and_read(manifest.mapInPandas(offsets, schema), "token-manifest")


def map_documents(manifest: DataFrame, rows_of: Callable[[int | None, int, np.ndarray], tuple], schema: str) -> DataFrame:
    """One row for each document of the files: ``rows_of(key, start, ids)``; the ids are a view of the mapped file."""
    names = [f.split()[0] for f in schema.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                ids = get_array(r.folder, f"tokens-{r.part:06d}.bin", r.dtype)
                starts = get_array(r.folder, f"offsets-{r.part:06d}.bin", "<i8")
                keys = get_array(r.folder, f"keys-{r.part:06d}.bin", "<i8")
                for first in range(0, len(keys), 1000):
                    rows = [
                        rows_of(None if k == NULL_KEY else int(k), int(a), ids[a - r.base : b - r.base])
                        for k, a, b in zip(
                            keys[first : first + 1000], starts[first : first + 1000], starts[first + 1 : first + 1001]
                        )
                    ]
                    columns = {n: pd.array([x[i] for x in rows]) for i, n in enumerate(names[:1])}
                    columns |= {n: [x[i] for x in rows] for i, n in enumerate(names) if i}
                    yield pd.DataFrame(columns)

    tasks = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    return tasks.mapInPandas(read, schema)


def read_documents(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``start``, ``ids`` of every document in the files."""
    return map_documents(manifest, lambda k, start, ids: (k, start, ids.astype("int64")), f"{key} bigint, start bigint, ids array<bigint>")


def document_digests(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``start``, ``n_tokens`` and ``ids_crc32`` over the ids as little-endian 32-bit integers."""

    def digest(k, start, ids):
        import zlib

        return k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    return map_documents(manifest, digest, f"{key} bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
