"""Quality rules: how well public vocabularies fit a text.

A text that real tokenisers were not made for falls into many short tokens, into single
bytes, or into very few different tokens. For each vocabulary the words of a text are
tokenised, and characters per token, the share of byte-fallback tokens and the entropy of
the token counts are measured over the whole text. Bands per script (or language) say
which values are refused.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from flowlark.llm.text import BLOCK_BYTES, SPACES, blocks, coded, joined_counts, let_go, mixed, owners, pieces, raw_bytes, sums, word_ranges

PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SCRIPTS = ["latin", "other", "none"]


@dataclass(frozen=True)
class Band:
    """Values outside are refused. Entropy is held against the bits that so few tokens can have:
    the bound is a share of log2(number of tokens), which short texts reach easily."""

    chars_per_token: tuple[float, float] = (0.9, 8.0)
    byte_share: float = 0.5
    entropy_share: float = 0.35


#: For each vocabulary, by script. Latin: the 0.1 % points of characters per token and of the entropy share and the 99.9 % point
#: of the byte share, rounded outwards, over the 2,573 texts of sf0.1 that have quality 1, pass the base rules and whose
#: crc32(doc_id) leaves no 0 by 5 (the others test the bands). The piece vocabulary gives these texts no byte at all; it gets
#: the bound of the other one. No labelled text is in another script, so those bounds are set by hand: up to three byte
#: tokens a character, and a text of nearly only bytes, or of few different tokens, is refused.
OTHERS = {"other": Band((0.25, 8.0), 0.95, 0.5), "none": Band((0.25, 64.0), 0.5, 0.3)}
BANDS = [{"latin": Band((1.80, 8.0), 0.0123, 0.749), **OTHERS}, {"latin": Band((1.90, 8.0), 0.0123, 0.754), **OTHERS}]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_tokens(path: str):
    """A function from words to (ids, tokens of each word), and which ids are bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return lambda words: flat(model.encode(words, num_threads=1)), is_byte


def rank_tokens(path: str):
    """The same for a file of ranks; a token that is no valid text by itself counts as bytes."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    is_byte, opens = np.zeros((2, max(ranks.values()) + 1), bool)
    for token, rank in ranks.items():
        is_byte[rank] = len(token) == 1 and token[0] >= 128
        opens[rank] = token[:1] == b" "

    def tokens(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(encoding.encode_ordinary("".join(f" {w}" for w in words)), np.int64)
        starts = np.flatnonzero(opens[ids]) if len(ids) else ids
        if len(starts) == len(words) and (not len(ids) or opens[ids[0]]):
            return ids, np.diff(np.r_[starts, len(ids)])
        return flat([encoding.encode_ordinary(" " + w) for w in words])

    return tokens, is_byte


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


LOADED: dict = {}


def vocabulary(path: str):
    """Loaded once in a worker."""
    if path not in LOADED:
        LOADED[path] = rank_tokens(path) if path.endswith(".tiktoken") else piece_tokens(path)
    return LOADED[path]


def script_of(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each word that are Latin, and all its letters."""
    return tuple(pc.count_substring_regex(distinct, p).to_numpy(zero_copy_only=False).astype(np.int64) for p in (r"\p{Latin}", r"\p{L}"))


def repeated_words(codes: np.ndarray, firsts: np.ndarray, size: int = 3) -> np.ndarray:
    """Words that lie in a window of `size` words found at least twice in the same text, by text."""
    n = len(codes)
    covered = np.zeros(n, bool)
    if n >= size:
        doc = owners(firsts)
        key = codes[: n - size + 1]
        for k in range(1, size):
            key = np.unique(key * (codes.max() + 1) + codes[k : n - size + 1 + k], return_inverse=True)[1] if k < size - 1 else key * (codes.max() + 1) + codes[k : n - size + 1 + k]
        whole = doc[: n - size + 1] == doc[size - 1 :]
        at = np.flatnonzero(whole)
        key = np.unique(key[at], return_inverse=True)[1]
        if len(at):
            _, back, times = np.unique(doc[at] * (key.max() + 1) + key, return_inverse=True, return_counts=True)
            hit = at[times[back] > 1]
            for k in range(size):
                covered[hit + k] = True
    return sums(covered, firsts)


def repeated_lines(bytes_: np.ndarray, begins: np.ndarray, has_word: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    cut = np.zeros(len(bytes_) + 1, bool)
    cut[np.flatnonzero(bytes_ == 10) + 1] = True
    cut[begins] = True
    starts = np.flatnonzero(cut[:-1])
    if not len(starts):
        return np.zeros(len(begins) - 1, np.int64)
    ends = np.r_[starts[1:], len(bytes_)]
    ends = ends - (bytes_[ends - 1] == 10)
    doc = np.searchsorted(begins, starts, "right") - 1
    words = np.r_[0, np.cumsum(has_word)]
    full = words[ends] > words[starts]
    starts, ends, doc = starts[full], ends[full], doc[full]
    out = np.zeros(len(begins) - 1, np.int64)
    if len(starts):
        codes, _ = coded(pieces(bytes_, starts, ends, pa.binary()))
        group, _, n = joined_counts(doc, codes)
        np.add.at(out, group, n - 1)
    return out


def entropies(doc: np.ndarray, ids: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Bits of the distribution of ids in each text; an id counts with its weight."""
    out = np.zeros(n)
    if len(ids):
        width = np.int64(ids.max() + 1)
        keys, back = np.unique(doc * width + ids, return_inverse=True)
        count = np.bincount(back, weight)
        group = keys // width
        total = np.bincount(group, count, n)
        part = count / total[group]
        out = np.bincount(group, -part * np.log2(part), n)
    return np.maximum(out, 0.0)


def measured(block: pa.RecordBatch, paths: list[str]) -> dict[str, np.ndarray]:
    """All measures of the texts of a block."""
    bytes_, begins = raw_bytes(block.column(block.schema.get_field_index("text")))
    starts, ends, firsts = word_ranges(bytes_, begins)
    codes, distinct = coded(pieces(bytes_, starts, ends))
    words = distinct.to_pylist()
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    latin, letters = script_of(distinct)
    n_words = np.diff(firsts)
    word_chars, n_latin, n_letters = (sums(x[codes], firsts) for x in (lengths, latin, letters))
    out = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": sums(SYMBOLS[bytes_], begins),
        "n_dup_lines": repeated_lines(bytes_, begins, ~SPACES[bytes_]),
        "n_repeat_words": repeated_words(codes, firsts),
        "script": np.where(n_letters == 0, 2, np.where(2 * n_latin >= n_letters, 0, 1)),
    }
    doc, word, times = joined_counts(owners(firsts), codes)
    for k, path in enumerate(paths):
        encode, is_byte = vocabulary(path)
        ids, counts = encode(words)
        from_ = np.r_[0, np.cumsum(counts)]
        tokens = sums(counts[codes], firsts)
        byte_tokens = sums(sums(is_byte[ids], from_)[codes], firsts)
        many = counts[word]
        each = np.repeat(from_[word] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        some = np.maximum(tokens, 1)
        out |= {
            f"n_tokens_{k}": tokens,
            f"chars_per_token_{k}": word_chars / some,
            f"byte_share_{k}": byte_tokens / some,
            f"entropy_{k}": entropies(np.repeat(doc, many), ids[each], np.repeat(times, many), len(n_words)),
        }
    return out


def refused(m: dict[str, np.ndarray], k: int, bands: dict[str, Band]) -> np.ndarray:
    """Texts outside the band of their script under vocabulary k. A text without words is outside none."""
    low, high, share, least = (np.array([f(bands[s]) for s in SCRIPTS])[m["script"]] for f in (lambda b: b.chars_per_token[0], lambda b: b.chars_per_token[1], lambda b: b.byte_share, lambda b: b.entropy_share))
    fertility, tokens = m[f"chars_per_token_{k}"], m[f"n_tokens_{k}"]
    most = np.log2(np.maximum(tokens, 2))
    few = m[f"entropy_{k}"] < least * np.minimum(most, 8.0)
    return (tokens > 0) & ((fertility < low) | (fertility > high) | (m[f"byte_share_{k}"] > share) | few)


def fertility(
    docs: DataFrame, paths: list[str] | None = None, bands: list[dict[str, Band]] | None = None, least_words: int = 50, most_repeated: int = 50, keep: list[str] | None = None, kept_only: bool = False
) -> DataFrame:
    """Measures and verdict of each row of docs (doc_id, text); every text is read whole.

    paths: vocabulary files (.model or .tiktoken), by default a piece and a byte vocabulary.
    bands: one mapping from script to Band for each vocabulary, as BANDS. A text fails the base rules with fewer than `least_words` words,
    or when more than `most_repeated` percent of its words lie in repeated windows of three.
    kept_only: only rows that are kept; refused texts do not leave the task.
    keep: further columns of docs to pass on, with the text. A null text counts as an empty one and
    fails; a null doc_id stays null; repeated rows give repeated results; other columns are not looked
    at, and those to keep must not have the name of a result; an empty table gives an empty result.
    """
    paths = paths or [vocabulary_path(PIECES), vocabulary_path(RANKS)]
    bands = bands or BANDS
    measures = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    vocab = "".join(f", n_tokens_{k} long, chars_per_token_{k} double, byte_share_{k} double, entropy_{k} double" for k in range(len(paths)))
    schema = f"doc_id long, {measures}, script string{vocab}, base_failed boolean, kept boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    passed = ["text", *keep] if keep else []
    schema += "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in passed)

    def verdicts(batches):
        for block in blocks(batches, BLOCK_BYTES // 2):
            m = measured(block, paths)
            base = (m["n_words"] < least_words) | (100 * m["n_repeat_words"] > most_repeated * m["n_words"])
            out = base.copy()
            for k in range(len(paths)):
                out |= refused(m, k, bands[k])
            m |= {"doc_id": block.column(0), "base_failed": base, "kept": ~out, "script": np.array(SCRIPTS)[m["script"]]}
            kept = {k: block.column(block.schema.get_field_index(k)) for k in passed}
            made = pa.RecordBatch.from_pydict({n: m[n] for n in names} | kept)
            yield made.filter(pa.array(~out)) if kept_only else made

    def run(batches):
        try:
            yield from verdicts(batches)
        finally:
            let_go(LOADED)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(k) for k in keep or [])]
    return docs.select(*columns).mapInArrow(run, schema)
