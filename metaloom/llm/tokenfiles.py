"""Token ids in binary files, each document compressed alone with a shared Zstandard dictionary.

A text is encoded by the tokenizers library.  Pieces between blanks and line ends are encoded once each and
remembered: the tokenizer drops white space and no token crosses it, so the ids of a text are those of its pieces.
The end id follows each document.

The dictionary is trained once, on the serialized ids of at most ``TRAIN_DOCS`` different documents of at most
``TRAIN_IDS`` ids, taken by hash; only how small the files become depends on it.  It is a file of its own, named by its
SHA-256, which the head of every token file holds.

A token file holds a head, one Zstandard frame for each document, an index (document, offset of its frame, ids before
it) and a footer that says where the index begins.  So a single short document is read by two seeks and a frame.  Files
hold ranges of documents in ascending order; the manifest has a row for each file, with its place in that order, its
first and last document, and its counts.  The ids before a document are those of earlier files, a running sum over the
manifest, and those before it in its file.

Results for odd input.  A null or empty text has no token but the end id.  A null doc_id stands before all others and
stays null.  Documents that share an id, equal or not, are documents of their own, in the order of a hash of their ids;
however many they are, they spread over all tasks.  Other columns are ignored.  An empty table writes no token file and
gives an empty result.

A file is written under a name of the attempt's own and then renamed; the manifest names only finished files, so a task
that runs again leaves at most a file that nothing names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloom.llm.base import NULL_ID, folder as folder_of, known_id, new_path, partitions, real_id, saved, ship, small_batches

END_ID = 2
#: Documents and ids a document that the dictionary is trained on at most, and its size in bytes.
TRAIN_DOCS, TRAIN_IDS, DICTIONARY_BYTES = 1000, 4096, 1 << 16
#: Compressed bytes after which a file is closed, and plain bytes of ids in a range of documents.
FILE_BYTES, RANGE_BYTES, LEVEL = 1 << 26, 1 << 27, 3
#: Bytes that a task reads at once.
READ_BYTES = 1 << 23
#: Pieces of text that a worker remembers, and characters of the longest of them.
REMEMBERED, LONGEST = 1 << 20, 64
#: What is cut off the end of a piece, and the first character that no word of plain letters has.
PUNCTUATION, UNUSUAL = ".,;:!?", "\u0500"
#: The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = dict(zip([b for b in range(256) if b not in _PRINTS], range(256, 512)))
MAGIC = b"MTOK"
#: Magic, version, bytes an id, end id, SHA-256 of the dictionary; then offset and size of the index, documents, magic.
HEAD, FOOT = struct.Struct("<4sBBI32s"), struct.Struct("<QQQ4s")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """One tokenizer file; ids come as bytes of the smallest width that holds the vocabulary."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.known = Tokenizer.from_file(path), Known(self._piece)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.width = 2 if max(self.tok.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.model = self.tok.model

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _unit(self, text: str) -> bytes:
        """The ids of a piece without white space.  A word of plain letters is one pre-token, which goes to the model as it
        is, in the characters that stand for its bytes; all else takes the library's whole way."""
        word = text.lower()
        if not word.isascii():
            plain = word.isalpha() and max(text) < UNUSUAL and "\u03a3" not in text and unicodedata.is_normalized("NFC", text)
            word = word.encode().decode("latin-1").translate(BYTE_CHARS) if plain else ""
        elif not word.isalpha():
            word = ""
        if word:
            return self._pack([t.id for t in self.model.tokenize(word)])
        return self._pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece; punctuation after a letter is cut off, as the tokenizer does, since few words have many ends."""
        word = piece.rstrip(PUNCTUATION)
        if len(word) == len(piece) or not word or not word[-1].lower().isalpha():
            return self._unit(piece)
        return self.known[word] + self.known[piece[len(word) :]]

    def encode(self, text: str) -> bytes:
        """The ids of a text, without an end id."""
        ids = b"".join(map(self.known.__getitem__, (text.lower() if text.isascii() else text).replace("\n", " ").split(" ")))
        if len(self.known) > REMEMBERED:
            for p in list(itertools.islice(self.known, REMEMBERED // 2)):
                del self.known[p]
        return ids


class Known(dict):
    """Pieces and their ids; a new piece is encoded, and remembered unless it is long."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc, ids): the serialized ids of each document with the end id."""
    small_batches(docs.sparkSession)

    def run(batches):
        e = encoder(path)
        end = np.array([end_id], e.kind).tobytes()
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf["doc"], "ids": [e.encode(text) + end for text in pdf["text"]]})

    rows = docs.select(known_id().alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc long, ids binary")


def train_dictionary(ids: DataFrame, width: int) -> bytes:
    """A dictionary from a bounded number of documents; of few documents their plain content; empty if there are none."""
    short = ids.filter(F.octet_length("ids") <= TRAIN_IDS * width).withColumn("hash", F.xxhash64("ids"))
    every = max(1, short.agg(F.approx_count_distinct("hash")).first()[0] // TRAIN_DOCS)
    taken = short.filter(F.pmod("hash", F.lit(every)) == 0).groupBy("hash").agg(F.min("ids").alias("ids"))
    samples = [bytes(r["ids"]) for r in taken.orderBy("hash").limit(TRAIN_DOCS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _codec_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class Writer:
    """Writes one token file."""

    def __init__(self, out, width: int, end_id: int, dictionary: bytes, name: bytes):
        self.out, self.zip = out, zstandard.ZstdCompressor(level=LEVEL, dict_data=_codec_dictionary(dictionary))
        self.docs, self.offsets, self.before, self.width = [], [HEAD.size], [0], width
        out.write(HEAD.pack(MAGIC, 1, width, end_id, name))

    def add(self, doc: int, ids: bytes) -> None:
        self.docs.append(doc)
        self.offsets.append(self.offsets[-1] + self.out.write(self.zip.compress(ids)))
        self.before.append(self.before[-1] + len(ids) // self.width)

    def close(self) -> None:
        index = zstandard.compress(b"".join(np.array(x, "<i8").tobytes() for x in (self.docs, self.offsets, self.before)))
        self.out.write(index + FOOT.pack(self.offsets[-1], len(index), len(self.docs), MAGIC))
        self.out.close()


class Reader:
    """Reads the head and the index of one token file, then any of its documents."""

    def __init__(self, file, dictionary_of):
        self.file = file
        size = file.size()
        magic, version, self.width, self.end_id, self.name = HEAD.unpack(self._at(0, HEAD.size))
        at, length, n, again = FOOT.unpack(self._at(size - FOOT.size, FOOT.size))
        if magic != MAGIC or again != MAGIC or version != 1:
            raise ValueError("no token file")
        index = np.frombuffer(zstandard.decompress(self._at(at, length)), "<i8")
        self.docs, self.offsets, self.before = index[:n], index[n : 2 * n + 1], index[2 * n + 1 :]
        dictionary = dictionary_of(self.name)
        if hashlib.sha256(dictionary).digest() != self.name:
            raise ValueError("the dictionary is not that of the file")
        self.unzip = zstandard.ZstdDecompressor(dict_data=_codec_dictionary(dictionary))

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, i: int, j: int | None = None):
        """The ids of documents i to j as unsigned 32-bit arrays, read in few and bounded pieces."""
        j = i + 1 if j is None else j
        while i < j:
            stop = i + 1
            while stop < j and self.offsets[stop + 1] - self.offsets[i] <= READ_BYTES:
                stop += 1
            at = int(self.offsets[i])
            data = self._at(at, int(self.offsets[stop]) - at)
            for k in range(i, stop):
                plain = self.unzip.decompress(data[int(self.offsets[k]) - at : int(self.offsets[k + 1]) - at])
                yield np.frombuffer(plain, f"<u{self.width}").astype("<u4")
            i = stop


def dictionary_at(folder: str):
    """Reads a dictionary of a folder by its SHA-256."""

    @functools.lru_cache(maxsize=4)
    def of(name: bytes) -> bytes:
        files, base = folder_of(folder)
        with files.open_input_file(f"{base}/{name.hex()}.zdict") as f:
            return f.read()

    return of


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Writes the token files of documents and returns their manifest:
    (folder, file, n_docs, n_ids, start, first_doc, last_doc), a row for each file."""
    spark, path = docs.sparkSession, path or default_path()
    folder, width = folder or new_path(spark, "tokens"), encoder(path).width
    ids = saved(encoded(docs, path, end_id), "token-ids")
    dictionary = train_dictionary(ids, width)
    name = hashlib.sha256(dictionary).digest()
    files, base = folder_of(folder)
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/{name.hex()}.zdict") as f:
        f.write(dictionary)
    size = ids.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    order = ["doc", "tie", "row"]
    # Rows that are equal in document and ids are told apart by their number, so they spread over several ranges.
    keyed = ids.select("doc", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("row"), "ids")
    ranges = keyed.repartitionByRange(max(partitions(spark), size // RANGE_BYTES), *order).sortWithinPartitions(*order)

    def write(batches):
        files, base = folder_of(folder)
        writer = name_ = None
        place = 0

        def done():
            writer.close()
            files.move(f"{base}/{name_}.part", f"{base}/{name_}")
            return pd.DataFrame([(shard, place, name_, len(writer.docs), writer.before[-1], writer.docs[0], writer.docs[-1])], columns=["shard", "place", "file", "n_docs", "n_ids", "first_doc", "last_doc"])

        for pdf in batches:
            shard = int(pdf["shard"].iloc[0]) if len(pdf) else 0
            for doc, data in zip(pdf["doc"], pdf["ids"], strict=True):
                if writer is None:
                    name_ = f"{uuid.uuid4().hex}.mtok"
                    writer = Writer(files.open_output_stream(f"{base}/{name_}.part"), width, end_id, dictionary, name)
                writer.add(int(doc), data)
                if writer.offsets[-1] >= FILE_BYTES:
                    yield done()
                    writer, place = None, place + 1
        if writer is not None:
            yield done()

    small_batches(spark)
    written = ranges.select(F.spark_partition_id().alias("shard"), "doc", "ids").mapInPandas(write, "shard int, place int, file string, n_docs long, n_ids long, first_doc long, last_doc long")
    written = saved(written, "token-files")
    before = Window.orderBy("shard", "place").rowsBetween(Window.unboundedPreceding, -1)
    manifest = written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return saved(manifest.select(F.lit(folder).alias("folder"), "file", "n_docs", "n_ids", "start", "first_doc", "last_doc"), "token-manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), and the ids if asked for, of each document, from the files alone."""
    spark = manifest.sparkSession
    ship(spark)
    kinds = "doc long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches):
        for pdf in batches:
            for folder, name, start in zip(pdf["folder"], pdf["file"], pdf["start"], strict=True):
                files, base = folder_of(folder)
                with files.open_input_file(f"{base}/{name}") as f:
                    r, out = Reader(f, dictionary_at(folder)), []
                    for k, ids in enumerate(r.ids(0, len(r.docs))):
                        if len(ids) != r.before[k + 1] - r.before[k]:
                            raise ValueError(f"{name}: the index and document {k} differ")
                        out.append((r.docs[k], start + r.before[k], len(ids), zlib.crc32(ids.tobytes()), *[ids.astype("i8")] * with_ids))
                        if len(out) == 4096:
                            yield pd.DataFrame(out, columns=["doc", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
                            out = []
                    yield pd.DataFrame(out, columns=["doc", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    tasks = max(partitions(spark), manifest.agg(F.count(F.lit(1))).first()[0])
    got = manifest.select("folder", "file", "start").repartition(tasks, "file").mapInPandas(read, kinds)
    return got.select(real_id("doc").alias("doc_id"), *[c.split()[0] for c in kinds.split(", ")[1:]])


def fetch(manifest: DataFrame, doc_id: int | None) -> list[list[int]]:
    """The ids of the documents with an id: from the files whose range holds it, by their index, one frame each."""
    doc, out = NULL_ID if doc_id is None else doc_id, []
    for row in manifest.filter((F.col("first_doc") <= doc) & (F.col("last_doc") >= doc)).orderBy("start").collect():
        files, base = folder_of(row["folder"])
        with files.open_input_file(f"{base}/{row['file']}") as f:
            r = Reader(f, dictionary_at(row["folder"]))
            i, j = np.searchsorted(r.docs, [doc, doc], "left")[0], np.searchsorted(r.docs, doc, "right")
            out += [ids.tolist() for ids in r.ids(int(i), int(j))]
    return out


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes all documents to token files, reads them back, and returns a row for each document."""
    return read_tokens(write_tokens(docs, path))
