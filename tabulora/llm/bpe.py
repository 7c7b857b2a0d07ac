"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Each text is cut into pre-tokens by a pattern. A block of documents keeps, for each position, the number of its word in
the block's list of distinct words; the lists are dealt out by word, so that equal words meet, each distinct word is
encoded once there (per memo of bounded size), and its ids go back to the blocks that have it, where the documents are
put together by position. Decoding joins the ids with the table of the tokens' bytes.

Blocks are written before their words are dealt out, so a lost task finds the same blocks again. They are written in
buckets by their names, so only the ids move when the two meet. A word is at most one entry for each block, so no word is
a hot key.

Defined results: null or empty text: no tokens; equal rows: returned as often as they came; text of one endless word:
encoded whole; special tokens: ordinary text; null id: returned as null.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulora.llm.common import Work, out_batch, partitions

#: Characters of a block, words of a memo.
BLOCK, MEMO = 4 << 20, 500_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from lines of base64 and rank; ranks are 0, 1, 2 and on."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def encoder(tokens: list[bytes], pattern: str):
    """Bytes of one pre-token to ids; the library merges by rank, the lowest first."""
    import tiktoken

    core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return core._encode_single_piece


def _pack(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _press(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _expand(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def _narrow(codes: np.ndarray) -> bytes:
    """32-bit numbers: a byte for each, and for those from 255 on four planes of bytes."""
    far = codes[codes >= 255].astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.minimum(codes, 255).astype(np.uint8).tobytes() + np.ascontiguousarray(far.T).tobytes()


def _widen(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """n numbers that begin at a place, and where they end."""
    out = np.frombuffer(raw, np.uint8, n, at).astype(np.uint32)
    far = out == 255
    m = int(far.sum())
    out[far] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * m, at + n).reshape(4, -1).T).view("<u4").ravel()
    return out, at + n + 4 * m


def _squeeze(codes: np.ndarray) -> bytes:
    return _press(len(codes).to_bytes(8, "little") + _narrow(codes))


def _unsqueeze(raw: bytes) -> np.ndarray:
    raw = _expand(raw)
    return _widen(raw, 8, int.from_bytes(raw[:8], "little"))[0]


#: A block's own row has part -1, the numbers of its words by position (the commonest word has the least) and the part of
#: each number's word, the ids and word counts of its documents; a row with part p >= 0 has those of its words, or their
#: ids, that are dealt to p, in the order of their numbers.
DEAL = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("data", pa.binary()), ("parts", pa.binary()), ("id", pa.list_(pa.int64())), ("n", pa.list_(pa.int32()))])
DEAL_SQL = "block long, part int, data binary, parts binary, id array<bigint>, n array<int>"
IDS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])


def _pack_all(items: list[bytes], width: int = 1) -> bytes:
    """Items of numbers of `width` bytes, which lie in as many planes."""
    lengths = np.array([len(x) // width for x in items], np.uint32)
    planes = np.frombuffer(b"".join(items), np.uint8).reshape(-1, width)
    return _press(len(items).to_bytes(4, "little") + _narrow(lengths) + np.ascontiguousarray(planes.T).tobytes())


def _unpack_all(raw: bytes, width: int = 1) -> list[bytes]:
    raw = _expand(raw)
    n = int.from_bytes(raw[:4], "little")
    lengths, at = _widen(raw, 4, n)
    body = np.ascontiguousarray(np.frombuffer(raw, np.uint8, -1, at).reshape(width, -1).T).tobytes()
    ends = [0, *np.cumsum(lengths.astype(np.int64) * width).tolist()]
    return [body[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _split(pattern, n_parts):
    def run(batches):
        import regex
        import xxhash

        cut = regex.compile(pattern).findall

        def block(ids, texts):
            own: dict = {}
            codes, n = [], []
            for t in texts:
                words = cut(t)
                n.append(len(words))
                codes.append(np.array([own.setdefault(w, len(own)) for w in words], np.uint32))
            codes = np.concatenate(codes)
            common = np.argsort(-np.bincount(codes, minlength=len(own)), kind="stable")
            number = np.empty(len(own), np.uint32)
            number[common] = np.arange(len(own), dtype=np.uint32)
            words = [w.encode() for w in own]
            part = np.array([xxhash.xxh3_64_intdigest(w) % n_parts for w in words], np.int64)
            order = np.lexsort((number, part))
            name = xxhash.xxh3_64(repr(ids).encode())
            for t in texts:
                name.update(t.encode() + b"\xff")
            name = name.intdigest() - (1 << 63)
            rows = [(name, -1, _squeeze(number[codes]), _squeeze(part[common]), ids, n)]
            bounds = np.searchsorted(part[order], np.arange(n_parts + 1)).tolist()
            order = order.tolist()
            for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if b > a:
                    rows.append((name, p, _pack_all([words[k] for k in order[a:b]]), None, None, None))
            return out_batch(DEAL, *zip(*rows, strict=True))

        for rb in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(rb.column("id").to_pylist(), rb.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > BLOCK:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield block(ids, texts)

    return run


def _encode(tokens, pattern):
    """Gives the words of each row their ids; a word is encoded once, as long as the memo holds it."""

    def run(batches):
        encode = encoder(tokens, pattern)
        memo: dict = {}
        for rb in batches:
            out = []
            for data in rb.column("data").to_pylist():
                ids = []
                for w in _unpack_all(data):
                    x = memo.get(w)
                    if x is None:
                        x = memo[w] = _pack(encode(w))
                    ids.append(x)
                out.append(_pack_all(ids, 4))
                if len(memo) > MEMO:
                    memo.clear()
            yield out_batch(IDS, rb.column("block"), rb.column("part"), out)

    return run


OUT = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def _assemble(tokens):
    """Of a block's own row and the ids of its words: the ids in order, and the bytes that they decode to."""

    def run(own: pa.Table, ids: pa.Table) -> pa.Table:
        lists = dict(zip(ids["part"].to_pylist(), ids["data"].to_pylist(), strict=True))  # an equal block has the same words
        words = [w for p in sorted(lists) for w in _unpack_all(lists[p], 4)]
        done = []
        for data, parts, doc_ids, counts in zip(*(own[c].to_pylist() for c in ("data", "parts", "id", "n")), strict=True):
            table = [b""] * len(words)
            for number, w in zip(np.argsort(_unsqueeze(parts), kind="stable").tolist(), words, strict=True):
                table[number] = w
            codes, at = _unsqueeze(data).tolist(), 0
            for i, n in zip(doc_ids, counts, strict=True):
                row = b"".join([table[c] for c in codes[at : at + n]])
                at += n
                done.append((i, len(row) // 4, row, b"".join(map(tokens.__getitem__, np.frombuffer(row, "<u4").tolist()))))
        return pa.Table.from_batches([out_batch(OUT, *zip(*done, strict=True))] if done else [], OUT)

    return run


def encode_decode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_tokens, ids (little-endian unsigned 32-bit integers) and the bytes that they decode to.

    Each id is looked up in the table of the tokens' bytes, which has a row for each rank and no more than the file of
    ranks, in the order of the ranks."""
    work = Work(docs.sparkSession, "bpe")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tokens, n = read_ranks(ranks), partitions(work.spark)
    blocks = work.buckets(rows.mapInArrow(_split(pattern, n), DEAL_SQL), "blocks", "block")
    dealt = blocks.where("part >= 0").select("block", "part", "data").repartitionById(n, F.col("part"))
    ids = dealt.mapInArrow(_encode(tokens, pattern), "block long, part int, data binary")
    own = blocks.where("part < 0").select("block", "data", "parts", "id", "n")
    return own.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_assemble(tokens), "id long, n_tokens long, ids binary, decoded binary")


def op6_byte_level_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
