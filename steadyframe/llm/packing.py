"""Best-fit packing of token pieces by hierarchical residual rounds."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadyframe.llm.common import materialize, pieces, trim

PIECE = "id long, piece int, start long, length long, crc long"
#: A bin on its way: its fill and its pieces in order.
BIN = "fill long, open boolean, members array<struct<id:long,piece:int,start:long,length:long,crc:long>>"
MEMBER = pa.struct([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])
ARROW_BIN = pa.schema([("fill", pa.int64()), ("open", pa.bool_()), ("members", pa.list_(MEMBER))])


def bpe_encoder(tokenizer: str) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """Encoder of the named public vocabulary: texts to arrays of ids.

    The byte-level vocabulary is read through its rank file by tiktoken, which gives the same ids as its JSON file
    does in tokenizers (tests compare them) at a sixth of the CPU time. Added tokens of the JSON file are found in
    texts, as tokenizers does even without special tokens added: they are cut out, and what lies between is encoded
    piece by piece.
    """

    def make():
        import base64
        import json
        import re

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(tokenizer.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        code = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
            tokens = json.load(f)["added_tokens"]
        if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must match as they are written")
        added = {t["content"]: t["id"] for t in tokens}
        cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        def encode(texts: list[str]) -> list[np.ndarray]:
            return [np.array(encode_one(t), dtype="<u4") for t in texts]

        def encode_one(text: str) -> list[int]:
            parts = cut.split(text) if cut else [text]
            if len(parts) == 1:
                return ordinary(text)
            out: list[int] = []
            for k, part in enumerate(parts):  # every other part is an added token
                out += [added[part]] if k % 2 else ordinary(part)
            return out

        def ordinary(text: str) -> list[int]:
            return code.encode_ordinary(text) if len(text) < 1 << 20 else encode_long(text)

        def encode_long(text: str) -> list[int]:
            """Very long texts go in parts cut where a blank follows a letter, which no token crosses."""
            out, at = [], 0
            while at < len(text):
                end = at + (1 << 20)
                while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
                    end += 1
                out += code.encode_ordinary(text[at:end])
                at = end
            return out

        return encode

    return make


def tokenize(docs: DataFrame, id_col: str, text_col: str, size: int, end_id: int, tokenizer: str) -> DataFrame:
    """One row per piece of at most ``size`` tokens; of a longer document the first piece may be shorter."""
    encoder = bpe_encoder(tokenizer)

    def run(batches):
        encode = encoder()
        for whole in batches:
            for batch in pieces(whole, 8 << 20):
                rows: list[tuple] = []
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for id_, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                    raw = ids.tobytes() + end_id.to_bytes(4, "little")
                    n = len(raw) // 4
                    cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                    rows += [(id_, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["id", "piece", "start", "length", "crc"])
        trim()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECE)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Best fit, longest first: lists of item numbers, one per bin."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free space
    held = 0  # bit r: some bin has r free
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        fits = held >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                held &= ~(1 << r)
        else:
            r, b = size, len(bins)
            bins.append([])
        bins[b].append(k)
        if r > n:
            room[r - n].append(b)
            held |= 1 << (r - n)
    return bins


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 1024,
    end_id: int = 2,
    tokenizer: str = "byte_bpe_50k.json",
    nearly_full: float = 0.998,
    items_per_task: int = 50_000,
    fan_in: int = 8,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id and offset.

    Full pieces are sequences of their own. Others are packed best-fit within each partition; bins filled to
    ``nearly_full`` leave, and the underfull ones are the items of the next round, on up to ``fan_in`` times fewer
    partitions, until a round has had them all in one partition or no longer saves one bin in two hundred. A task has
    about ``items_per_task`` items at most in any round. Null and empty texts are the end token alone;
    repeated rows are packed like others.
    """
    if size < 1:
        raise ValueError("size must be positive")
    made = materialize(tokenize(docs, id_col, text_col, size, end_id, tokenizer), "pieces")
    member = F.struct("id", "piece", "start", "length", "crc")
    items = made.select(F.col("length").alias("fill"), (F.col("length") < size).alias("open"), F.array(member).alias("members"))
    done = [items.where("not open").select("members")]
    rest, n = items.where("open"), made.where(F.col("length") < size).count()
    parts = max(1, -(-n // items_per_task))
    while n:
        last = parts == 1
        full = size if last else int(np.ceil(nearly_full * size))
        bins = materialize(rest.repartition(parts).mapInArrow(_round(size, full, last), BIN), "bins")
        done.append(bins.where("not open").select("members"))
        rest, before = bins.where("open"), n
        n = rest.count()
        if last or not n:
            break
        if n > before * 0.995:
            done.append(rest.select("members"))
            break
        parts = min(parts, max(-(-n // items_per_task), -(-parts // fan_in)))
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionAll(d)
    return bins.mapInArrow(_numbered(id_col), f"{id_col} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _round(size: int, full: int, last: bool):
    """Best fit of one partition's items, in parts of bounded size; bins that reach ``full`` (all, in the last round) are closed."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 400_000 and not last:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    def packed(held):
        t = pa.Table.from_batches(held)
        fills, members = t.column("fill").to_numpy(), t.column("members").combine_chunks()
        bins = best_fit(fills, size)
        order = pa.array([k for b in bins for k in b], pa.int64())
        taken = members.take(order)
        sizes = np.diff(taken.offsets.to_numpy())
        ends = np.cumsum([len(b) for b in bins])
        offsets = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends))]
        fill = np.add.reduceat(fills[order.to_numpy()], np.concatenate(([0], ends[:-1])))
        joined = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), taken.flatten())
        open_ = np.zeros(len(fill), bool) if last else fill < full
        out = pa.table([pa.array(fill), pa.array(open_), joined], names=ARROW_BIN.names).cast(ARROW_BIN)
        yield from out.to_batches(max_chunksize=20_000)

    return run


def _numbered(id_col: str):
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            members = batch.column(0)
            rows, sizes = members.flatten(), np.diff(members.offsets.to_numpy())
            length = rows.field("length").to_numpy()
            total = np.concatenate(([0], np.cumsum(length)))
            begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            offset = total[:-1] - np.repeat(total[begin], sizes)
            number = at + np.repeat(np.arange(len(sizes)), sizes)
            at += len(sizes)
            yield pa.RecordBatch.from_arrays([rows.field("id"), rows.field("piece"), rows.field("start"), rows.field("length"), rows.field("crc"), pa.array(number), pa.array(offset)], names=names)

    return run
