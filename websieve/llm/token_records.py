"""Token ids as length-delimited binary records with masked checksums and an offset index.

A shard is two files. ``<name>.rec`` holds one frame per document::

    u64 length | u32 masked crc of these 8 bytes | payload | u32 masked crc of the payload

and the payload is ``u8 id width (2 or 4) | u8 has doc_id | i64 doc_id | ids``, all little-endian.
``<name>.idx`` holds a u64 offset for each frame, so shuffled readers can seek. A checksum is
zlib's crc32, rotated right by 15 bits plus a constant, so that a checksum over data that
itself holds checksums stays sound.

Documents are range-partitioned by id and sorted in each partition, then encoded and written
by the task that holds them; only texts are shuffled, not ids. Files carry the attempt in
their names and count only if the task's manifest row was committed, so a lost executor or a
repeated task leaves nothing behind that a reader would see.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import attempt_name, keyed, make_folder, map_batches, new_folder, open_path, partitions_for, staged

#: Fixed value: what the mask adds to a rotated checksum.
MASK_DELTA = 0xA282EAD8
#: ASCII bytes: visible ones, letters and digits, and marks.
SEEN = np.zeros(256, bool)
SEEN[33:127] = True
WORDY = np.zeros(256, bool)
WORDY[[b for b in range(128) if chr(b).isalnum()]] = True
MARK = SEEN & ~WORDY
#: UTF-8 of other characters that are, or have been, white space: by their last two and last three bytes.
SPACES = [c.encode() for c in map(chr, range(128, 0xD800)) if c.isspace() or c == "\u180e"]
SPACES_2, SPACES_3 = ([int.from_bytes(c) for c in SPACES if len(c) == n] for n in (2, 3))


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(read) -> bytes | None:
    """The next payload from read(n), None at the end; ValueError if a check fails."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("a record's length fails its checksum")
    n = struct.unpack("<Q", head[:8])[0]
    body = read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("a record's payload fails its checksum")
    return body[:n]


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return struct.pack("<BBq", width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, known, doc_id = struct.unpack("<BBq", payload[:10])
    return doc_id if known else None, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def cuttable(spec: dict) -> bool:
    """Whether a tokenizer's file describes what Encoder's cuts rely on."""
    pre, post, model = spec.get("pre_tokenizer") or {}, spec.get("post_processor") or {"type": "ByteLevel"}, spec.get("model") or {}
    plain = not any((spec.get("normalizer"), spec.get("truncation"), spec.get("padding"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix")))
    return plain and pre.get("type") == post["type"] == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("type", "BPE") == "BPE"


def cuts_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces of UTF-8 begin that the usual pre-tokenizer never joins: at the starts of texts and

    * at a space or line feed after a character that isn't white space: of its tokens, only
      ``\\s+`` and the one space before a word hold white space, and both begin with it;
    * at an ASCII mark after an ASCII letter or digit, or one of the letters U+00C0 to U+00FF:
      no token goes on from a letter or a digit to a mark.

    A token that begins at such a place doesn't depend on what is before it, and what is
    after a piece matters only to white space at its end, which is there in a text's last only.
    """
    gap = np.flatnonzero((data == 32) | (data == 10))
    before = data[gap - 1]
    cut = SEEN[before]
    far = np.flatnonzero(before > 127)
    at = gap[far]
    two = data[at - 2].astype(np.int32) << 8 | before[far]
    cut[far] = ~(np.isin(two, SPACES_2) | np.isin(data[at - 3].astype(np.int32) << 16 | two, SPACES_3))
    begins = np.zeros(len(data), bool)
    begins[gap[cut]] = True
    mark = np.flatnonzero(MARK[data])
    before = data[mark - 1]
    cut = WORDY[before]
    far = np.flatnonzero(before > 127)
    cut[far] = (data[mark[far] - 2] == 0xC3) & (before[far] != 0x97) & (before[far] != 0xB7)
    begins[mark[cut]] = True
    begins[starts] = True
    return np.flatnonzero(begins)


def gathered(pool: np.ndarray, at: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool[at[s] : at[s + 1]] of each slot s in one array, and how many these are."""
    first = at[slots]
    n = at[slots + 1] - first
    index = np.repeat(first - np.cumsum(n) + n, n)
    index += np.arange(len(index))
    return pool[index], n


class Encoder:
    """The library's ids of whole texts, with a memory of pieces; of a memory that has grown too
    large, in pieces or in ids, only what the last block of pieces needed is kept.

    Whole texts go to the library unless its file names a byte-level BPE with the usual
    pre-tokenizer (``cuttable``), and so does a text that holds a string of an added token; with
    ``special_as_text`` the strings of special tokens are ordinary text.

    All others are cut where that pre-tokenizer always cuts (``cuts_of``), so equal pieces have
    equal ids, and only pieces that the memory lacks go to the library. Short ones go many in one
    string if each has its only white space, a space or a line feed, in front: such a string
    is cut between them, and only the first id of each begins with white space.
    """

    JOINED = re.compile(r"[ \n][^\s\u180e]{1,64}").fullmatch

    def __init__(self, path: str, remember: int = 1_000_000, special_as_text: bool = False, block: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or [] if not (special_as_text and t["special"])]
        self.cuts = cuttable(spec)
        if not self.cuts:
            return
        self.remember, self.block = remember, block
        self.memory, self.pool, self.at = {}, np.zeros(0, "<u4"), np.zeros(1, np.int64)  # a piece's slot, all ids, where a slot's begin
        front = tuple(self.tokenizer.encode(c, add_special_tokens=False).tokens[0] for c in " \n")
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)  # which ids begin with a space or a line feed
        self.starts[[i for t, i in vocabulary.items() if t.startswith(front)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.frombuffer(array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids), "<u4")

    def _learn(self, pieces: list[str], together: int = 500) -> np.ndarray:
        """Remember the ids of new pieces; the slots they get."""
        fits = [self.JOINED(p) is not None for p in pieces]
        joined, other = list(compress(pieces, fits)), [p for p, f in zip(pieces, fits) if not f]
        parts, sizes = [], []
        for k in range(0, len(joined), together):
            ids = self._ids("".join(joined[k : k + together]))
            parts.append(ids)
            sizes.append(np.diff(np.flatnonzero(self.starts[ids]), append=len(ids)))
            if len(sizes[-1]) != len(joined[k : k + together]):
                raise ValueError("joined pieces don't fall apart again")
        apart = list(map(self._ids, other))
        ends = np.cumsum(np.concatenate([*sizes, [len(ids) for ids in apart]]), dtype=np.int64)
        base, fits = len(self.at) - 1, np.array(fits)
        slots = base + np.where(fits, np.cumsum(fits) - 1, len(joined) + np.cumsum(~fits) - 1)
        self.memory.update(zip(pieces, slots.tolist()))
        self.at = np.concatenate([self.at, ends + len(self.pool)])
        self.pool = np.concatenate([self.pool, *parts, *apart])
        return slots

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where the ids of each text end) of texts without added tokens; the starts of the
        texts in their joint UTF-8 end with its length."""
        cuts = cuts_of(data, starts[:-1][starts[:-1] < len(data)])
        bounds, parts, sizes = np.append(cuts, len(data)), [], [np.zeros(1, np.int64)]
        for k in range(0, len(cuts), self.block):
            offsets = bounds[k : k + self.block + 1]
            words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
            names = words.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
            slots = np.fromiter(map(self.memory.get, names, repeat(-1)), np.int64, len(names))
            new = np.flatnonzero(slots < 0)
            if len(new):
                slots[new] = self._learn([names[i] for i in new.tolist()])
            ids, n = gathered(self.pool, self.at, slots[words.indices.to_numpy()])
            parts.append(ids)
            sizes.append(n)
            if len(self.memory) > self.remember or len(self.pool) > 8 * self.remember:
                self.pool, n = gathered(self.pool, self.at, slots)
                self.memory, self.at = dict(zip(names, range(len(names)))), np.append(0, np.cumsum(n))
        ends = np.cumsum(np.concatenate(sizes))
        return np.concatenate([np.zeros(0, "<u4"), *parts]), ends[np.searchsorted(cuts, starts[1:])]

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where the ids of each text end) of whole texts; a null is empty."""
        texts = texts.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        _, offsets, held = texts.buffers()
        starts = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(held or b"", np.uint8)[starts[0] : starts[-1]]
        starts = starts - starts[0]
        joint, whole = data.tobytes(), range(len(texts))
        if self.cuts:
            found = [a for a in self.added if a in joint]
            whole = [k for k in whole if any(a in joint[starts[k] : starts[k + 1]] for a in found)] if found else []
        parts, ends, done, first = [], [], 0, 0
        for k in [*whole, len(texts)]:  # the texts before each of these are cut together
            if first < k:
                ids, stops = self._pieces(data[starts[first] : starts[k]], starts[first : k + 1] - starts[first])
                parts.append(ids)
                ends.append(done + stops)
                done += len(ids)
            if k < len(texts):
                parts.append(self._ids(joint[starts[k] : starts[k + 1]].decode()))
                done += len(parts[-1])
                ends.append([done])
            first = k + 1
        return np.concatenate(parts), np.concatenate(ends)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text as little-endian u32."""
        ids, ends = self.rows(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches, enc: Encoder) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, ids) of each row."""
    for batch in batches:
        ids, ends = enc.rows(batch.column(1))
        start = 0
        for key, end in zip(batch.column(0).to_pylist(), ends.tolist()):
            yield key, ids[start:end]
            start = end


MANIFEST = "part int, seq int, file string, records long, tokens long"


def write_records(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, shard_bytes: int = 256 << 20) -> DataFrame:
    """Encode and write all rows in ascending id order; a manifest row per shard, in order.

    Nulls: a null text is empty, so its record is the end id alone; a null id comes first.
    Ties: rows that repeat an id are ordered by text. An empty table writes no shard. Other
    columns are ignored. Ids must be integers.
    """
    spark = docs.sparkSession
    make_folder(folder)
    tail = np.array([end_id], "<u4")

    def run(batches):
        from pyspark import TaskContext

        part, seq, out, shards = TaskContext.get().partitionId(), 0, None, []

        def close():
            rec, offsets, name, tokens, fs, path = out
            rec.close()
            with fs.open_output_stream(f"{path}.idx") as idx:
                idx.write(np.array(offsets[:-1], "<u8").tobytes())
            shards.append((part, seq, name, len(offsets) - 1, tokens))

        for doc_id, ids in encoded(batches, encoder(tokenizer)):
            if out is None:
                name = f"{folder}/{attempt_name('ids')}-{seq:04d}"
                fs, path = open_path(name)
                out = [fs.open_output_stream(f"{path}.rec", buffer_size=1 << 20), [0], name, 0, fs, path]
            ids = np.concatenate([ids, tail])
            data = frame(pack(doc_id, ids))
            out[0].write(data)
            out[1].append(out[1][-1] + len(data))
            out[3] += len(ids)
            if out[1][-1] >= shard_bytes:
                close()
                seq, out = seq + 1, None
        if out is not None:
            close()
        if shards:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*shards), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "seq", "file", "records", "tokens"])

    d = keyed(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    d = d.repartitionByRange(partitions_for(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(map_batches(d, run, MANIFEST), "manifest").orderBy("part", "seq")


def _read(manifest: DataFrame, schema: str, emit) -> DataFrame:
    """emit(list of (doc_id, start, ids)) makes the columns of schema; all checks applied.

    Of the manifest, a row per shard of up to 256 MB, only counts come to the driver.
    """
    spark, base, rows = manifest.sparkSession, 0, []
    for m in manifest.collect():
        rows.append((m.file, base))
        base += m.tokens
    files = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = open_path(name)
                with fs.open_input_stream(f"{path}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8")
                rows, at, k, held = [], 0, 0, 0
                with fs.open_input_stream(f"{path}.rec", buffer_size=1 << 20) as f:
                    while (payload := unframe(f.read)) is not None:
                        if k >= len(offsets) or offsets[k] != at:
                            raise ValueError(f"{name}: record {k} isn't where the index says")
                        at, k = at + len(payload) + 16, k + 1
                        doc_id, ids = unpack(payload)
                        rows.append((doc_id, base, ids))
                        base, held = base + len(ids), held + len(ids)
                        if held >= 1 << 20:
                            yield emit(rows)
                            rows, held = [], 0
                if k != len(offsets):
                    raise ValueError(f"{name}: {k} records, {len(offsets)} in the index")
                if rows:
                    yield emit(rows)

    return map_batches(files, run, schema)


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in all shards), ids of each record."""

    def emit(rows):
        flat = np.concatenate([r[2] for r in rows]).astype(np.int32)
        ends = np.cumsum([0] + [len(r[2]) for r in rows]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "start", "ids"])

    return _read(manifest, "doc_id long, start long, ids array<int>", emit)


def record_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian u32) of each record."""

    def emit(rows):
        cols = zip(*((i, start, len(ids), zlib.crc32(ids.tobytes())) for i, start, ids in rows))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", emit)


def shuffled_read(name: str, seed: int):
    """The records of one shard in a random order, through its offset index."""
    fs, path = open_path(name)
    offsets = np.frombuffer(fs.open_input_stream(f"{path}.idx").read(), "<u8")
    with fs.open_input_file(f"{path}.rec") as f:
        for k in np.random.default_rng(seed).permutation(len(offsets)):
            f.seek(int(offsets[k]))
            yield unpack(unframe(f.read))


def token_records(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, folder: str | None = None, end_id: int = 2) -> DataFrame:
    """Write docs as token records, read them back and return their digests."""
    folder = folder or new_folder(docs.sparkSession, "token-records")
    return record_digests(write_records(docs, folder, tokenizer, id_col, text_col, end_id=end_id))
