"""Chat formatting at token level: segments are encoded separately, reserved ids spliced between, masks derived by prefix sums, control strings in contents escaped."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder and file of the vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's own way to split a text (fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Reserved strings; their ids follow the vocabulary's.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that count as control strings when they occur in contents (fixed values).
CONTROL = (TURN, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|eot_id|>")
GUARD = "⁠"
_NAKED = re.compile("|".join(f"{re.escape(c[0])}{GUARD}*{re.escape(c[1:])}" for c in CONTROL))
_GUARDED = re.compile("|".join(f"{re.escape(c[0])}{GUARD}+{re.escape(c[1:])}" for c in CONTROL))
TRAINED = "assistant"
#: Turns of one packed row and of what a task holds at once.
SPAN = 512


def escape(text: str) -> str:
    """One guard more behind the first character of every control string, guarded or not; reversible for any text."""
    return _NAKED.sub(lambda m: m[0][0] + GUARD + m[0][1:], text)


def unescape(text: str) -> str:
    return _GUARDED.sub(lambda m: m[0][0] + m[0][2:], text)


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = {s: len(ranks) + k for k, s in enumerate((TURN, BODY, END))}
    return tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=own)


def assemble(enc: tiktoken.Encoding, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a turn and its loss mask: the body of a trained role."""
    mark = lambda s: [enc.encode_single_token(s)]
    parts = [mark(TURN), enc.encode_ordinary(escape(role)), mark(BODY), enc.encode_ordinary(escape(text)), mark(END)]
    at = np.cumsum([0, *map(len, parts)])
    mask = np.zeros(at[-1], bool)
    mask[at[3] : at[4]] = role == TRAINED
    return np.concatenate([np.asarray(p, np.int32) for p in parts]), mask


def read_back(enc: tiktoken.Encoding, ids: np.ndarray) -> tuple[str, str]:
    """(role, text) from the ids of a turn."""
    body = int(np.flatnonzero(ids == enc.encode_single_token(BODY))[0])
    return unescape(enc.decode(ids[1:body].tolist())), unescape(enc.decode(ids[body + 1 : -1].tolist()))


TURNS = "conv_id long, turn long, ids array<int>, mask array<boolean>"


def formatted(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, turn, ids, mask) for each row; a conversation's ids are those of its turns in order. Null roles and texts count as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            made = [assemble(enc, r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.bool_()))], ["conv_id", "turn", "ids", "mask"])

    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, TURNS)


def _pack(vocabulary: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            held: dict[tuple, list] = {}
            for conv, turn, ids, mask in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                ids = np.array(ids, np.int32)
                role, text = read_back(enc, ids)
                loss = unescape(enc.decode(ids[np.array(mask, bool)].tolist()))
                at = -(2**63) if turn is None else turn
                held.setdefault((conv, at // SPAN), []).append({"turn": at, "role": role, "text": text, "loss": loss, "chars": len(enc.decode(ids.tolist()))})
            item = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.string()), ("chars", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()), pa.array(list(held.values()), item)], ["conv_id", "span", "turns"])

    return run


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    now = spanning = None
    span: list[dict] = []
    state: list = []

    def flush() -> None:
        for t in sorted(span, key=lambda t: (t["turn"], t["role"], t["text"])):
            state[0] += 1
            state[1].update(f"{t['role']}\n{t['text']}\n".encode())
            state[2] += len(t["loss"])
            state[3].update(t["loss"].encode())
            state[4] += t["chars"]
        span.clear()

    def close() -> None:
        flush()
        out.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def rows() -> pa.RecordBatch:
        names = [c.split()[0] for c in DIGEST.split(", ")]
        kinds = [pa.string() if "sha" in n else pa.int64() for n in names]
        b = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
        out.clear()
        return b

    for b in batches:
        for conv, at, turns in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if now != (conv,):
                if now:
                    close()
                now, spanning, state = (conv,), at, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            elif spanning != at:
                flush()
                spanning = at
            span += turns
        if out:
            yield rows()
    if now:
        close()
        yield rows()


def digests(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each conversation, read back from the ids and masks. Turns stand by number, nulls first, ties by role and text; rows without a conv_id are one conversation.
    Null roles and texts are empty, texts of any length are encoded whole, repeated rows are turns of their own, an empty table gives no rows.

    Encoding is row by row; turns are packed before the shuffle, so that a conversation with very many of them reaches its digest, which is
    sequential by nature, as few rows, and that task holds SPAN turn numbers at a time.
    """
    packed = formatted(turns, vocabulary).mapInArrow(_pack(vocabulary), "conv_id long, span long, turns array<struct<turn:long,role:string,text:string,loss:string,chars:long>>")
    return packed.repartition("conv_id").sortWithinPartitions("conv_id", "span").mapInArrow(_digest, DIGEST)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more))


_ESCAPED = f"len(regexp_extract_all({{0}}, '{_NAKED.pattern}')) + length({{0}})"
#: The same digests from the table: a turn is its three reserved strings, its role and its text, each control string in them one guard longer.
ORACLE = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
coalesce(sum(length(text)) filter (role = '{TRAINED}'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = '{TRAINED}'), '')) as loss_sha256,
sum({len(TURN + BODY + END)} + {_ESCAPED.format('role')} + {_ESCAPED.format('text')})::bigint as formatted_chars from t group by conv_id"""
