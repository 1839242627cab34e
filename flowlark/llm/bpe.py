"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over sixteen bytes cuts each text into chunks of some hundred bytes, so equal passages
give equal chunks wherever they stand. A chunk that many documents of a block share is encoded once,
and those that recur are kept for the blocks after it. A cut inside a word leaves two wrong ends: the
join is encoded again in a window of whole words around it, which grows until its first and last words
come out as the chunks beside it have them.
"""

from __future__ import annotations

import hashlib
import json
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from flowlark.llm.text import BLOCK_BYTES, SPACES, blocks, coded, let_go, pieces, raw_bytes

#: The pattern that splits a normalised text before the merges of the vocabulary: a fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters alone are in composed form already, and lower-case character by character.
PLAIN = r"^[\x09\x0A\x0C\x0D\x20-\x7E\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]*$"
#: Marks the end of a word; not among the PLAIN characters.
END = "\x01"
#: White space, digits, letters and other signs among the bytes of PLAIN text in lower case.
BYTE_KINDS = np.full(256, 3, np.uint8)
BYTE_KINDS[SPACES], BYTE_KINDS[ord("0") : ord("9") + 1], BYTE_KINDS[ord("a") : ord("z") + 1], BYTE_KINDS[128:] = 0, 1, 2, 2
#: Bytes of spans and their results that a worker keeps in each of two generations.
KEPT_BYTES = 12 << 20
#: Bytes under the rolling hash, a power of two; a text's first chunk is at least as long.
HASHED = 16
OUTPUTS = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def chunk_cuts(bytes_: np.ndarray, begins: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Where the chunks inside the texts begin: one place in `chunk`, by the HASHED bytes before it, never inside a character."""
    with np.errstate(over="ignore"):
        roll, width, base = bytes_.astype(np.uint32) + np.uint32(1), 1, 0x01000193
        while width < HASHED:
            back = roll.copy()
            back[width:] += roll[:-width] * np.uint32(pow(base, width, 1 << 32))
            roll, width = back, 2 * width
        roll ^= roll >> np.uint32(15)
        roll *= np.uint32(0x2C1B3C6D)
        roll ^= roll >> np.uint32(13)
    at = np.flatnonzero(roll[:-1] % np.uint32(chunk) == 0) + 1
    at = at[bytes_[at] & 0xC0 != 0x80]
    return at[at - begins[np.searchsorted(begins, at, "right") - 1] >= HASHED]


def word_edges(bytes_: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where white space follows a word, and where texts begin and end."""
    space = SPACES[bytes_]
    edge = np.zeros(len(bytes_) + 1, bool)
    edge[1:-1] = space[1:] & ~space[:-1]
    edge[begins] = True
    return np.flatnonzero(edge)


def merged(opens: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending intervals in place of those that overlap or are equal; intervals that only touch stay apart."""
    order = np.argsort(opens, kind="stable")
    opens, closes = opens[order], np.maximum.accumulate(closes[order])
    new = np.r_[True, opens[1:] >= closes[:-1]] if len(opens) else np.zeros(0, bool)
    return opens[new], closes[np.r_[np.flatnonzero(new)[1:] - 1, len(opens) - 1]] if len(opens) else closes


def repaired_joins(broken: np.ndarray, edges: np.ndarray, begins: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Ranges of bytes around the cuts `broken`, and what stands for each: (tokens, ids, decoded text).

    `encode` gives that triple for each byte range, ids and text beginning with a space for each token. A range
    is at first the word that the cut breaks. It is encoded with one more word on either side; if these two do not come
    out as they do alone, the chunks beside it are not yet agreed with, and the range grows to twice its words. A
    range that is a whole text has nothing to agree with.
    """
    at = np.searchsorted(edges, broken, "right") - 1
    texts = np.searchsorted(edges, begins)
    first, last = np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens, closes = merged(at, at + 1)
    found: dict[tuple[int, int], tuple] = {}
    while True:
        todo = np.array([(o, c) not in found for o, c in zip(opens.tolist(), closes.tolist())], bool)
        if not todo.any():
            return edges[opens], edges[closes], [found[k] for k in zip(opens.tolist(), closes.tolist())]
        o, c = opens[todo], closes[todo]
        text = np.searchsorted(texts, o, "right")
        first, last = texts[text - 1], texts[text]
        left, right = np.maximum(o - 1, first), np.minimum(c + 1, last)
        n = len(o)
        each = encode(edges[np.r_[left, left, c]], edges[np.r_[right, o, right]])
        wider_o, wider_c = opens.copy(), closes.copy()
        for i, k in enumerate(np.flatnonzero(todo).tolist()):
            whole, before, after = each[i], each[n + i], each[2 * n + i]
            ids, stop = whole[1], len(whole[1]) - len(after[1])
            if stop >= len(before[1]) and ids.startswith(before[1]) and ids[len(before[1]) : len(before[1]) + 1] in (b"", b" ") and ids.endswith(after[1]):
                mid = ids[len(before[1]) : stop], whole[2][len(before[2]) : len(whole[2]) - len(after[2])]
                found[int(o[i]), int(c[i])] = (whole[0] - before[0] - after[0], *mid)
            else:
                more = int(c[i] - o[i] + 1) // 2
                wider_o[k], wider_c[k] = max(o[i] - more, first[i]), min(c[i] + more, last[i])
        opens, closes = merged(wider_o, wider_c)


def word_ends(bytes_: np.ndarray) -> np.ndarray:
    """Whether a word of WORD_PATTERN ends with each byte of PLAIN text in lower case.

    There a byte is white space, a digit (a word of its own), part of a letter, or another sign. An apostrophe that
    follows no other sign opens a word with the letters of a short form after it.
    """
    kind = BYTE_KINDS[bytes_]
    after = np.r_[kind[1:], np.uint8(0)]
    ends = (kind != 0) & ((kind != after) | (kind == 1))
    padded = np.r_[bytes_, np.zeros(2, np.uint8)]
    one, two = padded[1:-1], padded[2:]
    opens = (bytes_ == ord("'")) & (np.r_[np.uint8(0), kind[:-1]] != 3)
    short = opens & np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = opens & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
    ends[short | long] = False
    ends[np.flatnonzero(short) + 1] = True
    ends[np.flatnonzero(long) + 2] = True
    return ends


def letters_of_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves,
    the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Encodes distinct spans once, keeping two generations of up to KEPT_BYTES of them in a worker.

    Plain spans go through the vocabulary as ranks, the end of a word being a byte of its own;
    that gives the library's merges because every token of the vocabulary is made by one merge.
    All other spans, and all spans of a vocabulary of another make, go through the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.id_text = pa.array([b" %d" % i for i in range(len(names))], pa.binary())
        self.token_text = pa.array([b" " + n.encode() for n in names], pa.binary())
        self.ranks = self.ranked(path, names)
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.kept = 0

    def ranked(self, path: str, names: list[str]):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, split = made["model"], made["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")
        merged = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if split != WORD_PATTERN or model["end_of_word_suffix"] != "</w>" or len(set(merged)) != len(merged):
            return None
        byte = letters_of_bytes()
        special = set(self.tokenizer.get_added_tokens_decoder())
        ranks = {}
        for i, name in enumerate(names):
            if i not in special:
                stem = name.removesuffix("</w>")
                ranks[bytes(byte[c] for c in stem) + END.encode() * (stem != name)] = i
        self.ends = np.array([n.endswith("</w>") for n in names])
        return tiktoken.Encoding("words", pat_str=rf"[^\s{END}]+{END}", mergeable_ranks=ranks, special_tokens={})

    def plain_ids(self, spans: list[str]) -> tuple[list[int], list[int]]:
        lines = pa.array(spans, pa.string())
        bytes_, begins = raw_bytes(pc.binary_join_element_wise(pc.utf8_lower(lines), "", "\n"))  # each line ends in a line end
        ends = word_ends(bytes_)
        marked = np.full(len(bytes_) + int(ends.sum()), ord(END), np.uint8)
        marked[np.arange(len(bytes_)) + np.cumsum(ends) - ends] = bytes_
        ids = self.ranks.encode_ordinary(marked.tobytes().decode())
        words = np.diff(np.r_[0, np.cumsum(ends)][begins])
        stops = np.r_[0, np.flatnonzero(self.ends[ids]) + 1] if ids else np.zeros(1, int)
        if len(stops) != words.sum() + 1:
            return self.any_ids(spans)
        return ids, np.diff(np.r_[0, stops[np.cumsum(words)]]).tolist()

    def any_ids(self, spans: list[str]) -> tuple[list[int], list[int]]:
        each = [self.tokenizer.encode(s, add_special_tokens=False).ids for s in spans]
        return [i for one in each for i in one], [len(one) for one in each]

    def texts(self, which: pa.Array, ids: np.ndarray, stops: np.ndarray) -> list[bytes]:
        """The values of `which` for the ids, put together up to each stop."""
        data, offsets = raw_bytes(which.take(ids))
        data, ends = data.tobytes(), offsets[stops].tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends)]

    def encoded(self, spans: list[str], often: np.ndarray, group: int = 2_000) -> list[tuple[int, bytes, bytes]]:
        """(tokens, ids as text, decoded text) of each span; both texts begin with a space if any. Spans marked `often` are kept."""
        young, old = self.young, self.old
        out = [young.get(s) or old.get(s) for s in spans]
        new = np.array([i for i, x in enumerate(out) if x is None], np.int64)
        if not len(new):
            return out
        texts = pa.array([spans[i] for i in new], pa.string())
        plain = pc.match_substring_regex(texts, PLAIN).to_numpy(zero_copy_only=False) & ~pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False) & (self.ranks is not None)
        for which, ids_of in ((new[plain], self.plain_ids), (new[~plain], self.any_ids)):
            for at in range(0, len(which), group):
                some = which[at : at + group].tolist()
                ids, counts = ids_of([spans[i] for i in some])
                ids, stops = np.array(ids, np.int32), np.cumsum(counts)
                for i, *found in zip(some, counts, self.texts(self.id_text, ids, stops), self.texts(self.token_text, ids, stops)):
                    out[i] = tuple(found)
        for i in new[often[new]].tolist():
            size = 2 * len(spans[i]) + len(out[i][1]) + len(out[i][2]) + 300
            if self.kept + size > KEPT_BYTES:
                self.young, self.old, self.kept = {}, self.young, 0
            if size <= KEPT_BYTES:
                self.young[spans[i]] = out[i]
                self.kept += size
        return out


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def encoded_block(block: pa.RecordBatch, path: str, outputs: list[str]) -> dict:
    """Token counts and outputs of the texts of a block."""
    bytes_, begins = raw_bytes(block.column(block.schema.get_field_index("text")))
    space, found = SPACES[bytes_], encoder(path)
    filled = np.r_[np.flatnonzero(~space), len(bytes_)]

    def encode(starts: np.ndarray, stops: np.ndarray) -> list[tuple]:
        """Results of ranges in any order, which may overlap; those of words recur and are kept."""
        starts = np.minimum(filled[np.searchsorted(filled, starts)], stops)  # white space before a range is dropped anyway
        codes, distinct = coded(pa.array([bytes_[i:j].tobytes() for i, j in zip(starts.tolist(), stops.tolist())], pa.binary()))
        spans = distinct.cast(pa.string()).to_pylist()
        table = found.encoded(spans, np.array([len(s) <= 24 for s in spans], bool))
        return [table[k] for k in codes.tolist()]

    cuts = chunk_cuts(bytes_, begins)
    broken = cuts[~(space[cuts] | space[cuts - 1])]
    opens, closes, joins = repaired_joins(broken, word_edges(bytes_, begins), begins, encode)
    starts = np.unique(np.r_[begins[:-1], cuts, opens, closes])
    starts = starts[starts < len(bytes_)]
    inside = np.searchsorted(opens, starts, "right") - 1
    inside[inside >= 0] = np.where(starts[inside >= 0] < closes[inside[inside >= 0]], inside[inside >= 0], -1)
    alone = (inside < 0) | (opens[inside] == starts) if len(opens) else np.ones(len(starts), bool)
    starts, inside = starts[alone], inside[alone]  # a range repaired at a join is one piece, whatever cuts lie in it
    stops = np.r_[starts[1:], len(bytes_)] if len(starts) else starts
    trimmed = np.minimum(filled[np.searchsorted(filled, starts)], stops)
    chunk = inside < 0
    own, distinct = coded(pieces(bytes_, trimmed[chunk], stops[chunk]))
    table = found.encoded(distinct.to_pylist(), np.bincount(own, minlength=len(distinct)) > 1) + joins
    codes = np.zeros(len(starts), np.int64)
    codes[chunk], codes[~chunk] = own, len(distinct) + inside[~chunk]
    count = np.array([x[0] for x in table], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    first = np.searchsorted(starts, begins)
    repaired = np.searchsorted(broken, begins)
    out: dict = {"n_tokens": np.diff(np.r_[0, np.cumsum(count)][first]), "n_repaired": np.diff(repaired)}
    out |= {name: [] for name in outputs}
    for i in range(len(begins) - 1):
        own = codes[first[i] : first[i + 1]].tolist()
        ids = b"".join([table[k][1] for k in own])[1:] if {"ids", "ids_sha256"} & set(outputs) else b""
        text = b"".join([table[k][2] for k in own])[1:] if {"decoded", "decoded_sha256"} & set(outputs) else b""
        for name in outputs:
            out[name].append(
                [int(x) for x in ids.split()] if name == "ids" else text.decode() if name == "decoded" else hashlib.sha256(ids if name == "ids_sha256" else text).hexdigest()
            )
    return out


def encode_decode(docs: DataFrame, path: str, outputs: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Ids and decoded text of each row of docs (doc_id, text), as the vocabulary's own library gives them.

    outputs: of OUTPUTS; digests are of the decimal ids joined by spaces and of the decoded text.
    keep: further columns of docs to pass on. n_repaired counts cuts inside words, whose joins are encoded again.
    A null text counts as empty (0 tokens, digest of the empty string); a null doc_id stays null;
    repeated rows give repeated results; an empty table gives an empty result.
    """
    outputs, keep = outputs or ["ids", "decoded"], keep or []
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(k) for k in keep])
    schema = ", ".join(["doc_id long", *(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "n_tokens long", "n_repaired long", *(f"{o} {OUTPUTS[o]}" for o in outputs)])

    def encoded(batches):
        for block in blocks(batches, BLOCK_BYTES // 2):
            found = encoded_block(block, path, outputs)
            kept = {k: block.column(block.schema.get_field_index(k)) for k in ("doc_id", *keep)}
            more = {o: pa.array(found[o], pa.list_(pa.int32()) if o == "ids" else pa.string()) for o in outputs}
            yield pa.RecordBatch.from_pydict({**kept, "n_tokens": found["n_tokens"], "n_repaired": found["n_repaired"], **more})

    def run(batches):
        try:
            yield from encoded(batches)
        finally:
            let_go(ENCODERS)

    return columns.mapInArrow(run, schema)
