"""URL filters: glob rules simulated all at once by a bit-parallel Shift-And automaton.

Every glob becomes a run of bits, one per state; the runs stand one after another in as many 64-bit words as they
need. Reading a byte c turns the active states D into ((D << 1) & enter[c]) | (D & stay[c]): enter holds the states
that c leads into, stay those with a loop on c. A batch of URLs is a matrix of such words, so one step of the
automaton costs a few vector operations for all URLs and all globs together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import ascii_lower, like


@dataclass(frozen=True)
class Rule:
    """verdict for all URLs of a host and its subdomains whose path starts with path. text is host + path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        """For the host itself and for its subdomains."""
        escaped = "".join("\\" + c if c in "*?\\" else c for c in self.text)
        return escaped + "**", "*." + escaped + "**"


class ShiftAnd:
    """All globs over one alphabet of bytes. `*`: any run without a slash, `**`: any run, `?`: any byte but a slash,
    `\\`: takes the next character as it is."""

    def __init__(self, globs: Sequence[str]):
        runs = [self._states(g) for g in globs]
        n = sum(len(r) for r in runs)
        self.words = max(1, -(-n // 64))
        bits = np.zeros((3, 256, self.words), np.uint64)  # enter, stay
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for run in runs:
            for k, (enter, stay) in enumerate(run):
                w, b = (at + k) // 64, np.uint64(1 << ((at + k) % 64))
                bits[0, enter, w] |= b
                bits[1, stay, w] |= b
                if not k:
                    self.start[w] |= b
            self.final.append(((at + len(run) - 1) // 64, np.uint64(1 << ((at + len(run) - 1) % 64))))
            at += len(run)
        self.enter, self.stay = bits[0], bits[1]
        self.absorbing = np.bitwise_and.reduce(self.stay, axis=0)

    @staticmethod
    def _states(glob: str) -> list[tuple[list[int], list[int]]]:
        """A state per byte to read, before it state 0: (bytes that lead into it, bytes that loop on it)."""
        every, flat = list(range(256)), [c for c in range(256) if c != ord("/")]
        states: list[tuple[list[int], list[int]]] = [([], [])]
        raw, i = glob.encode(), 0
        while i < len(raw):
            c = raw[i]
            if c == ord("*"):
                double = raw[i : i + 2] == b"**"
                enter, stay = states[-1]
                states[-1] = (enter, every if double or len(stay) == 256 else flat)
                i += 1 + double
                continue
            if c == ord("\\") and i + 1 < len(raw):
                i += 1
                states.append(([raw[i]], []))
            else:
                states.append((flat if c == ord("?") else [c], []))
            i += 1
        return states

    def match(self, texts: Sequence[str]) -> np.ndarray:
        """matches[i, g]: whether glob g fits the whole of text i. Costs one step per byte of the longest text whose
        states can still change; a text whose states are all dead or absorbing is settled."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        lengths = np.array([len(r) for r in raw], np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)[:-1])) if raw else lengths
        flat = np.frombuffer(b"".join(raw), np.uint8)
        states = np.tile(self.start, (len(raw), 1))
        live, step = np.flatnonzero(lengths > 0), 0
        one, carry = np.uint64(1), np.uint64(63)
        while len(live):
            c = flat[offsets[live] + step]
            d = states[live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> carry
            d = (moved & self.enter[c]) | (d & self.stay[c])
            states[live] = d
            step += 1
            live = live[(lengths[live] > step) & (((d & ~self.absorbing) != 0).any(1) | (((d << one) & ~d) != 0).any(1))]
        return np.stack([(states[:, w] & b) != 0 for w, b in self.final], 1) if self.final else np.zeros((len(raw), 0), bool)


def filter_urls(df: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of df: id, host, path, rule, verdict. Other columns of df are ignored.

    The host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path goes on
    from there up to `?`, `#` or the end. The longest rule that fits wins (of equally long ones the first); without
    one, rule is null and verdict is `default`. A null URL, an empty one and one without `://` have an empty host and
    path, so no rule fits. Repeated rows and null ids are kept row by row; very long URLs are read to the end of what
    can still change the verdict. An empty table gives an empty table. No shuffle: rows stay where they are read.
    """
    ordered = sorted(rules, key=lambda r: -len(r.text))
    spark = df.sparkSession
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = df.select(
        F.col(id_col),
        ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    schema = T.StructType([like(df, id_col), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])
    told = spark.sparkContext.broadcast((ShiftAnd([g for r in ordered for g in r.globs]), [r.text for r in ordered] + [None], [r.verdict for r in ordered] + [default]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, texts, verdicts = told.value
        for batch in batches:
            host, path = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            hits = automaton.match([h + p for h, p in zip(host, path, strict=True)])
            fits = np.ones((len(host), len(texts)), bool)
            fits[:, :-1] = hits[:, 0::2] | hits[:, 1::2]
            best = fits.argmax(1)
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array([texts[k] for k in best], pa.string()), pa.array([verdicts[k] for k in best], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "host", "path", "rule", "verdict"])

    return parts.mapInArrow(judge, schema)
