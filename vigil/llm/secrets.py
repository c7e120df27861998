"""Secret scans by one combined automaton.

All rules are compiled into one minimised automaton whose transitions are a flat
array, so one pass over a text's bytes looks for all of them.  Where a rule's
first match ends, a second automaton (the rule reversed) goes back to the
leftmost start, and a third (the rule alone) forward to the longest end.
Matches of one rule don't overlap; a match that fails its rule's least length is
dropped after it has taken its bytes.

Defined cases: a null or empty text has no matches; repeated rows give repeated
results; spans are in code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .automata import compile_rules
from .common import id_column, texts, tidy

SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


@dataclass(frozen=True)
class Rule:
    """least: least code points of a match, or of what follows its last character out of ``value`` if that is set."""

    kind: str
    pattern: str
    either_case: bool = False
    least: int = 1
    value: str = ""


#: Base rules in the order of their kinds. Matches of hex are maximal runs; as runs
#: under 24 digits fail, the pattern can ask for six digits, so that the automaton
#: doesn't stop at each letter from a to f.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6, "assign"),
    Rule("access", r"AKIA[A-Z0-9]+", False, 20),
    Rule("hex", r"[0-9a-f]{6}[0-9a-f]*", False, 24),
)
#: Further kinds, reported in ``spans`` only.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", False, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        import re

        self.rules = rules
        self.all = compile_rules([(r.pattern, r.either_case) for r in rules], True)
        self.on = [compile_rules([(r.pattern, r.either_case)], False) for r in rules]
        self.back = [compile_rules([(r.pattern, r.either_case)], False, True) for r in rules]
        self.value = [re.compile(r.pattern.encode(), re.I if r.either_case else 0) if r.value else None for r in rules]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, state) wherever the combined automaton is in a state that ends a match."""
        go, accept, s, out = self.all.next, self.all.accept, 0, []
        for i, b in enumerate(data):
            s = go[s + b]
            if s >= accept:
                out.append((i + 1, s))
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of the matches, in bytes."""
        taken, found = [0] * len(self.rules), []
        for end, state in self.ends(data):
            for r in self.all.rules[state // 256]:
                if end <= taken[r]:
                    continue
                go, s, start = self.back[r], 0, -1
                for i in range(end - 1, taken[r] - 1, -1):
                    s = go.next[s + data[i]]
                    if s >= go.accept:
                        start = i
                    elif s in go.dead:
                        break
                if start < 0:  # what ends here has begun inside the match before
                    continue
                go, s, last = self.on[r], 0, end
                for i in range(start, len(data)):
                    s = go.next[s + data[i]]
                    if s >= go.accept:
                        last = i + 1
                    elif s in go.dead:
                        break
                taken[r] = last
                rule = self.rules[r]
                size = last - start
                if rule.value:
                    size = len(self.value[r].fullmatch(data[start:last]).groups()[-1])
                if size >= rule.least:
                    found.append((start, r, last))
        return sorted(found)


@lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def code_points(data: bytes, at: list[int]) -> dict[int, int]:
    """Code point offsets of ascending byte offsets."""
    out, done, count = {}, 0, 0
    for x in sorted(set(at)):
        count += len(data[done:x].decode("utf-8", "replace"))
        done = x
        out[x] = count
    return out


def scan(df: DataFrame, text: str = "text", to: str = "secrets", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Add an array of (kind, start, end) of all secrets, by start and then the order of the rules."""
    kept = [c for c in df.columns if c != to]
    plain = df.select(*[id_column(df, c) for c in kept])
    schema = StructType([*plain.schema, StructField(to, SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @tidy
    def run(batches):
        s = scanner(rules)
        for batch in batches:
            out = []
            for value in texts(batch.column(kept.index(text))):
                data = value.as_buffer().to_pybytes()
                spans = s.spans(data)
                at = code_points(data, [x for a, _, b in spans for x in (a, b)]) if spans else {}
                out.append([{"kind": rules[r].kind, "start": at[a], "end": at[b]} for a, r, b in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, to])

    return plain.mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text", secrets: str = "secrets", by: str = "[SECRET]") -> DataFrame:
    """Replace each secret (overlapping ones together) in the text."""
    plain, kept = df, df.columns

    @tidy
    def run(batches):
        for batch in batches:
            values = batch.column(kept.index(text)).to_pylist()
            for i, spans in enumerate(batch.column(kept.index(secrets)).to_pylist()):
                if not spans:
                    continue
                parts, done = [], 0
                for x in spans:
                    if x["start"] >= done:
                        parts += [values[i][done : x["start"]], by]
                    done = max(done, x["end"])
                values[i] = "".join([*parts, values[i][done:]])
            columns = [pa.array(values, f.type) if f.name == text else c for f, c in zip(batch.schema, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return plain.mapInArrow(run, plain.schema)


def of_kinds(secrets: str, *kinds: str):
    return F.filter(secrets, lambda x: x["kind"].isin(*kinds))


def joined(spans):
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a digest of their spans, and all spans."""
    found = scan(docs.select("doc_id", "text")).select("doc_id", "secrets")
    kinds = tuple(r.kind for r in BASE)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(of_kinds("secrets", k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(joined(of_kinds("secrets", *kinds)), 256).alias("base_sha256"),
        joined("secrets").alias("spans"),
    )
