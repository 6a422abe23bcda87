"""Fill-in-middle transformation over a Roaring-style set of token boundaries.

A text is cut into tokens ``[space]*[not space]+|[space]+`` (the six white-space characters
of ``common.SPACE``); a cut after k tokens lies at the k-th token end. The ends of all
texts of a chunk, as offsets into the chunk, form one ``Boundaries`` set:

* offsets with the same upper 16 bits are one container, which keeps the lower 16 bits as a
  sorted array, a bitmap of 65,536 bits or a list of runs, whichever is the smallest;
* cumulative cardinalities say which container holds the r-th offset (container search), a
  lookup, a bit select or a run select inside it gives the offset (local select).

A text's own ends follow those of the texts before it, so its two cuts are two selects.

The form and the cuts come from a hash of seed and id, so they depend on no other row:
h1 to h4 are the first four groups of eight hex digits of sha256(``seed:id``). The prefix
ends after the smaller of h1 % (n + 1) and h2 % (n + 1) tokens, the middle after the
larger; a text is transformed if h3 % 100 < rate, as spm if h4 % 100 < spm rate, else psm.

Defined results: null texts count as empty; empty texts and those that hold a marker stay
plain; a null id hashes as the empty string; rows that repeat are transformed each, alike;
other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import chunks, table, texts

# --- fixed values ---------------------------------------------------------------------
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
ARRAY_MAX = 4096  # offsets of an array container; a bitmap is as large as so many
# --- end of fixed values ------------------------------------------------------------------
CHUNK = 1_000_000  # characters of the texts whose boundaries form one set

SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class Container:
    """Sorted distinct 16-bit values as an array, a bitmap or runs."""

    def __init__(self, low: np.ndarray):
        breaks = np.flatnonzero(np.diff(low) != 1) + 1
        starts = low[np.concatenate([[0], breaks])]
        if 4 * len(starts) < min(2 * len(low), 8192):  # two 16-bit numbers a run
            lengths = np.diff(np.concatenate([[0], breaks, [len(low)]]))
            self.kind, self.starts = "runs", starts.astype(np.uint16)
            self.before = np.cumsum(lengths) - lengths
        elif len(low) <= ARRAY_MAX:
            self.kind, self.values = "array", low.astype(np.uint16)
        else:
            bits = np.zeros(1 << 16, np.uint8)
            bits[low] = 1
            self.kind, self.words = "bitmap", np.packbits(bits, bitorder="little").view("<u8")
            ones = np.bitwise_count(self.words).astype(np.int64)
            self.before = np.cumsum(ones) - ones  # set bits before each word

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The values of the given ranks (from 0)."""
        if self.kind == "array":
            return self.values[rank].astype(np.int64)
        at = np.searchsorted(self.before, rank, side="right") - 1
        if self.kind == "runs":
            return self.starts[at].astype(np.int64) + rank - self.before[at]
        bits = np.unpackbits(self.words[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = (bits.cumsum(1) <= (rank - self.before[at])[:, None]).sum(1)
        return at * 64 + inside


class Boundaries:
    """A set of offsets with rank selection."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        self.keys = high[np.concatenate([[0], cuts])] if len(offsets) else high
        self.containers = [Container(part & 0xFFFF) for part in np.split(offsets, cuts)] if len(offsets) else []
        self.before = np.concatenate([[0], cuts]) if len(offsets) else np.zeros(0, np.int64)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """Offsets of the given ranks: container search, then local select."""
        out = np.empty(len(rank), np.int64)
        at = np.searchsorted(self.before, rank, side="right") - 1
        for c in np.unique(at):
            own = at == c
            out[own] = (self.keys[c] << 16) + self.containers[c].select(rank[own] - self.before[c])
        return out


def token_ends(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the token ends in the joined texts, number of tokens of each text)."""
    points = np.frombuffer("".join(docs).encode("utf-32-le"), "<u4")
    sizes = np.array([len(t) for t in docs], np.int64)
    last = np.cumsum(sizes)[sizes > 0] - 1
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    end = np.zeros(len(points), bool)
    end[:-1] = ~space[:-1] & space[1:]
    end[last] = True  # a text's last word or its closing space
    ends = np.flatnonzero(end) + 1
    return ends, np.diff(np.searchsorted(ends, np.concatenate([[0], np.cumsum(sizes)]), side="right"))


def draws(ids: list, seed: int) -> np.ndarray:
    """h1 to h4 of each id."""
    keys = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids]
    return np.frombuffer(b"".join(keys), ">u4").reshape(-1, 4).astype(np.int64)


def transform(docs: list[str], ids: list, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> dict[str, list]:
    """The columns of ``SCHEMA`` for a chunk of texts."""
    ends, n = token_ends(docs)
    h = draws(ids, seed)
    first = np.cumsum(n) - n
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    rank = (first[:, None] + cuts - 1).ravel()
    some = cuts.ravel() > 0  # the others cut before the first token
    offset = np.zeros(len(rank), np.int64)
    offset[some] = Boundaries(ends).select(rank[some])
    sizes = np.array([len(t) for t in docs], np.int64)
    at = np.maximum(offset.reshape(-1, 2) - (np.cumsum(sizes) - sizes)[:, None], 0) * (cuts > 0)
    forms, outputs, lengths = [], [], []
    for t, (a, b), chosen, spm in zip(docs, at.tolist(), h[:, 2] % 100 < rate, h[:, 3] % 100 < spm_rate):
        if not t or not chosen or PREFIX in t or SUFFIX in t or MIDDLE in t:
            forms.append("plain")
            outputs.append(t)
            lengths.append((None, None))
            continue
        head = f"{SUFFIX}{t[b:]}{PREFIX}{t[:a]}" if spm else f"{PREFIX}{t[:a]}{SUFFIX}{t[b:]}"
        forms.append("spm" if spm else "psm")
        outputs.append(f"{head}{MIDDLE}{t[a:b]}")
        lengths.append((a, b - a))
    return {"n": n.tolist(), "form": forms, "prefix_chars": [p for p, _ in lengths],
            "middle_chars": [m for _, m in lengths], "output": outputs}


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
                   spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the transformed text ``output``."""
    t = texts(docs, id_col, text_col)
    kind = t.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values, ids = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
            for a, b in chunks(values, CHUNK):
                out = transform(values[a:b], ids[a:b], seed, rate, spm_rate)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array(out["n"], pa.int64()), pa.array(out["form"], pa.string()),
                     pa.array(out["prefix_chars"], pa.int64()), pa.array(out["middle_chars"], pa.int64()),
                     pa.array(out["output"], pa.string())], ["doc_id", *out])

    return t.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def restored(output: Column, form: Column) -> Column:
    """The original text, from the transformed one and its form."""
    def parts(first, second):
        body = F.substr(output, F.lit(len(first) + 1))
        cut = F.instr(body, F.lit(second))
        rest = F.substr(body, cut + F.lit(len(second)))
        middle = F.instr(rest, F.lit(MIDDLE))
        return (F.substr(body, F.lit(1), cut - 1), F.substr(rest, F.lit(1), middle - 1),
                F.substr(rest, middle + F.lit(len(MIDDLE))))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same by the engine's own pattern matching; a token list stands for the boundary set.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
tok AS MATERIALIZED (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
cut AS (SELECT *, len(w)::BIGINT AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
       WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM tok),
parts AS (SELECT doc_id, n, form, text, array_to_string(list_slice(w, 1, a), '') AS p, array_to_string(list_slice(w, a + 1, b), '') AS m,
  array_to_string(list_slice(w, b + 1, n), '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
