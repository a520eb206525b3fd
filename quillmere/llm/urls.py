"""URL filters: all glob rules at once by a multiword Shift-And automaton over each canonical URL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.shared import ready

#: (action, host and path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: What the method itself blocks where no rule speaks: globs over "." + host + path; * stays within a part, ** does not.
GLOBS = ("*.doubleclick.*/**", "*.adserver.*/**", "*casino*/**", "*porn*/**", "*xxx*/**", "**/ads/**", "**/wp-login.php**", "**/cgi-bin/**", "**.exe", "**.apk", "**/../**", "*.onion/**")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_glob(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"*.{host}/{path}**"


class ShiftAnd:
    """Globs packed side by side into 64-bit words. Bit j of a glob: its first j symbols have been read."""

    def __init__(self, globs):
        steps, loops, self.first, self.last = {}, {}, [], []
        at = 0
        for glob in globs:
            raw, k = glob.encode(), 0
            self.first.append(at)
            while k < len(raw):
                if raw[k : k + 2] == b"**":
                    loops[at] = "any"
                    k += 2
                elif raw[k : k + 1] == b"*":
                    loops.setdefault(at, "part")
                    k += 1
                else:
                    at += 1
                    steps[at] = raw[k : k + 1]
                    k += 1
            self.last.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.step, self.loop = np.zeros((256, self.words), "u8"), np.zeros((256, self.words), "u8")
        for bit, byte in steps.items():
            rows = [b for b in range(256) if b != 0x2F] if byte == b"?" else [byte[0]]
            self.step[rows, bit // 64] |= np.uint64(1 << (bit % 64))
        for bit, kind in loops.items():
            rows = list(range(256)) if kind == "any" else [b for b in range(256) if b != 0x2F]
            self.loop[rows, bit // 64] |= np.uint64(1 << (bit % 64))
        self.start = np.zeros(self.words, "u8")
        for bit in self.first:
            self.start[bit // 64] |= np.uint64(1 << (bit % 64))

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Booleans, a row per text and a column per glob. Texts are read a byte at a time, all together, longest first."""
        sizes = np.array([len(t) for t in texts], dtype="i8")
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(texts), dtype="u1")
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1][order]
        live = len(texts) - np.searchsorted(sizes[order][::-1], np.arange(1, (sizes.max() if len(sizes) else 0) + 1), side="left")
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for k, n in enumerate(live):
            byte, held = flat[begin[:n] + k], state[:n]
            moved = held << one
            moved[:, 1:] |= held[:, :-1] >> top
            state[:n] = (moved & self.step[byte]) | (held & self.loop[byte])
        out = np.empty((len(texts), len(self.last)), dtype=bool)
        for j, bit in enumerate(self.last):
            out[order, j] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one != 0
        return out


def filter_urls(spark: SparkSession, pages: DataFrame, rules=RULES, globs=GLOBS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    The longest rule that fits decides; without one a glob of the method blocks, and all else is allowed. A null url, or
    one without ://, has an empty host and path, fits no rule and is allowed. Repeated rows are judged each, an empty
    table gives none, other columns are not read. A list of rules is a parameter, so its automaton goes out with the code.
    """
    ready(spark)
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    machine = ShiftAnd([*(rule_glob(r) for _, r in ranked), *globs])

    def run(batches):
        names = np.array([r for _, r in ranked] + [None], dtype=object)
        acts = np.array([a for a, _ in ranked] + [None], dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                hit = machine.run([x.encode() for x in part.column(3).to_pylist()])
                by_rule, by_glob = hit[:, : len(ranked)], hit[:, len(ranked) :].any(axis=1)
                which = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1) if len(ranked) else 0, len(ranked))
                verdict = np.where(which < len(ranked), acts[which], np.where(by_glob, "block", "allow"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(names[which].tolist(), pa.string()), pa.array(verdict.tolist(), pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host = F.translate(F.regexp_extract("rest_", r"(?s)^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract("rest_", r"(?s)^[^/?#]*([^?#]*)", 1)
    parts = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url_"))
        .withColumn("rest_", F.when(F.instr("url_", "://") > 0, F.expr("substring(url_, instr(url_, '://') + 3)")).otherwise(F.lit("")))
        .select("page_id", host.alias("host"), path.alias("path"))
    )
    return parts.withColumn("canonical", F.concat(F.lit("."), "host", "path")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


URL_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule, '.' || host || path AS u FROM b)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(u, '^([^/]*\.doubleclick\.[^/]*/.*|[^/]*\.adserver\.[^/]*/.*|[^/]*casino[^/]*/.*|[^/]*porn[^/]*/.*|[^/]*xxx[^/]*/.*|.*/ads/.*|.*/wp-login\.php.*|.*/cgi-bin/.*|.*\.exe|.*\.apk|.*/\.\./.*|[^/]*\.onion/.*)$', 's') THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
