"""Secret scans: fixed forms, and guess cost of values that stand where credentials stand."""
from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import cut, free_name, ship

#: Kinds of spans, in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "guess")

# The forms of the base scan. Letters of the keywords count in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS = 12

#: Where credentials stand: a keyword (also inside a longer name), a sign, and a value: if a quote opens it, all up to the
#: same quote, unescaped, on the same line (group 1, 2 or 3); else up to a blank, quote, comma, semicolon or bracket (group 4).
#: ``pass`` and ``auth`` end many words, so they count at the start of a name or in camel case only.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key"""
    r"""|(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[PA])))(?:pass|auth))"""
    r"""["'\]]?[\x20\t]*(?::=|=>|==|[:=])[\x20\t]*(?:bearer[\x20\t]+|basic[\x20\t]+)?"""
    r"""(?:"((?:[^"\\\r\n]|\\[^\r\n]){6,})"|'((?:[^'\\\r\n]|\\[^\r\n]){6,})'|`((?:[^`\\\r\n]|\\[^\r\n]){6,})`|["'`]?([^\s"'`,;<>(){}\[\]]{6,}))""",
    re.I | re.A,
)

# Common words of passwords and of stand-ins for them, the most common first.
COMMON_WORDS = """
password admin user test example secret token root login pass default changeme welcome letmein qwerty dragon master
monkey sunshine princess football baseball shadow superman batman iloveyou trustno hello freedom whatever computer
internet server database system service manager guest demo sample placeholder value string none null true false
empty your here insert replace todo dummy fake local localhost dev prod production staging public private key api
access auth config setting settings summer winter spring autumn january february march april june july august
september october november december monday tuesday wednesday thursday friday saturday sunday love angel charlie
michael jordan hunter ranger harley killer pepper ginger joshua cheese coffee orange banana apple google amazon
facebook github twitter the and for with from this that not are was have
""".split()
RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}
#: Words of the corpus that the dictionary takes in at most, from how many documents on, and their lengths.
MOST_WORDS, LEAST_DOCS = 50_000, 5
WORD_LENGTHS = range(3, 31)
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Every form with a keyword holds one of these and one of the signs; most texts are told by that.
KEYWORDS, SIGNS = ("pass", "pwd", "secret", "token", "credential", "key", "auth"), (":", "=")
#: Runs and walks end at any of so many characters, or at their full length.
INNER = 64
#: Distinct words that a task holds before it hands them on.
HELD_WORDS = 200_000

# Rows of keys, read both ways.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
NEXT_KEY = {(a, b) for row in KEY_ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:])}
# Signs that stand for letters.
LEET = str.maketrans("430157$@!", "aeoistsai")

DATE = re.compile(r"(?:19|20)\d\d(?P<s>[-/._]?)(?:0[1-9]|1[0-2])(?P=s)(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])(?P<t>[-/._]?)(?:0[1-9]|1[0-2])(?P=t)(?:19|20)\d\d|(?:19|20)\d\d")


def _char_bits(value: str) -> float:
    """Bits of one brute-forced character: the alphabets that the value draws on."""
    size = 0
    for chars, n in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), (r"[!-/:-@\[-`{-~]", 33), (r"[^\x00-\x7f]", 100)):
        if re.search(chars, value):
            size += n
    return log2(max(size, 2))


def guess_bits(value: str, ranks: dict[str, int] = RANK) -> float:
    """Least log2 guesses over all segmentations, by dynamic programming.

    A segment is a word of ``ranks`` (rank, with a bit for capitals or signs that stand for
    letters), a date, a run of one character or of a repeated unit of up to 4, a walk over
    neighbouring keys or letters, a separator, or a brute-forced character. Each segment but a
    single character adds two bits for its kind and place. Runs and walks are offered at
    each of their first ``INNER`` lengths and at their full one, so the cost is linear in the
    value's length; only in values with longer runs or walks a segmentation is left out.
    """
    n = len(value)
    if not n:
        return 0.0
    low = value.lower()
    plain = low.translate(LEET)
    per_char = _char_bits(value)
    longest = max(map(len, ranks), default=0) if len(ranks) < 1000 else 30
    best = [0.0] + [float("inf")] * n
    dates: dict[int, list[int]] = {}
    for i in range(n):
        m = DATE.match(value, i)
        if m:
            dates[i] = [m.end(), i + 4] if value[i : i + 4].isdigit() and value[i : i + 2] in ("19", "20") else [m.end()]
    # where the stretch of period 1..4 and the walk that begin at i end
    period_end = {}
    for p in (1, 2, 3, 4):
        same = 0
        ends = period_end[p] = [0] * n
        for i in range(n - 1, -1, -1):
            same = same + 1 if i + p < n and value[i] == value[i + p] else 0
            ends[i] = min(i + p + same, n)
    walk_end = [n] * (n + 1)
    for i in range(n - 2, -1, -1):
        walk_end[i] = walk_end[i + 1] if (low[i], low[i + 1]) in NEXT_KEY else i + 1
    for i in range(n):
        base = best[i]

        def offer(end: int, bits: float, base=base) -> None:
            if base + bits < best[end]:
                best[end] = base + bits

        offer(i + 1, 3.0 if value[i] in "_-./" else per_char)
        for k in range(3, min(longest, n - i) + 1):
            for text, extra in ((low, 0.0), (plain, 1.0)):
                rank = ranks.get(text[i : i + k])
                if rank:
                    capitals = 0.0 if value[i : i + k] == low[i : i + k] else 1.0
                    offer(i + k, 2 + log2(rank) + capitals + extra)
        for end in dates.get(i, ()):
            offer(end, 2 + (log2(366 * 120) + 1 if end - i > 4 else log2(120)))
        for p, ends in period_end.items():
            for end in (*range(i + max(3, 2 * p), min(ends[i], i + INNER)), ends[i]):
                if end - i >= max(3, 2 * p):
                    offer(end, 2 + p * per_char + log2((end - i) / p))
        for end in (*range(i + 3, min(walk_end[i], i + INNER)), walk_end[i]):
            if end - i >= 3:
                offer(end, 2 + log2(40) + log2(end - i))
    return best[n]


class Guesser:
    """``guess_bits`` by one dictionary, with a bounded memo of values."""

    def __init__(self, ranks: dict[str, int] = RANK):
        self.ranks = ranks
        self.memo: dict[str, float] = {}

    def __call__(self, value: str) -> float:
        if len(value) > 256:
            return guess_bits(value, self.ranks)
        bits = self.memo.get(value)
        if bits is None:
            if len(self.memo) >= 65_536:
                self.memo.clear()
            bits = self.memo[value] = guess_bits(value, self.ranks)
        return bits


def scan(text: str, min_bits: float, guesser: Guesser | None = None) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, end)`` of one text, by start, then by kind as listed; code points, end exclusive."""
    cost = guesser or Guesser()
    found = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    if may_assign(text, text.lower()):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
        for m in CONTEXT.finditer(text):
            if cost(m[m.lastindex]) >= min_bits:
                found.append(("guess", *m.span(m.lastindex)))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def may_assign(text: str, low: str) -> bool:
    """False where no keyword is followed by a sign, so that neither ``ASSIGN`` nor ``CONTEXT`` matches."""
    return any(c in text for c in SIGNS) and any(k in low for k in KEYWORDS)


def words_of(text: str) -> set[bytes]:
    """Words of a text in lower case, as UTF-8, without what stands where credentials stand.

    A word is a run of letters a to z and of characters outside ASCII.
    """
    if may_assign(text, text.lower()):
        text = ASSIGN.sub(" ", CONTEXT.sub(" ", text))
    if "AKIA" in text:
        text = ACCESS.sub(" ", text)
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def learn_ranks(docs: DataFrame, text: str = "text", most_words: int = MOST_WORDS, least_docs: int = LEAST_DOCS) -> dict[str, int]:
    """Ranks of the words of a corpus by the number of documents that have them, over all documents.

    Taken are words of 3 to 30 characters that stand in ``least_docs`` documents or more, the
    most frequent first (then by code point), of each number of documents all or none, so
    that there are at most ``most_words``. The fixed list of common passwords keeps its own
    ranks where these are lower. Null texts have no words.
    """
    ship(docs.sparkSession)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()

        def flush() -> pd.DataFrame:
            words = ((w.decode("utf-8", "replace"), n) for w, n in seen.items() if 3 <= len(w) <= 120)
            out = pd.DataFrame([x for x in words if len(x[0]) in WORD_LENGTHS], columns=["word", "n"])
            seen.clear()
            return out

        for part in parts:
            for t in part["text"]:
                seen.update(words_of(t or ""))
            if len(seen) > HELD_WORDS:
                yield flush()
        yield flush()

    counted = docs.select(F.col(text).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut(counted.where(F.col("n") >= least_docs))
    # how many words each number of documents has: few rows, the more frequent numbers first
    numbers = counted.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    run = F.sum("words").over(Window.partitionBy().orderBy(F.desc("n")))
    least = numbers.withColumn("run", run).where(F.col("run") <= most_words).agg(F.min("n").alias("n")).first()["n"]
    top = counted.where(F.col("n") >= least).collect() if least is not None else []  # at most most_words rows
    top.sort(key=lambda r: (-r["n"], r["word"]))
    ranks = {r["word"]: i + 1 for i, r in enumerate(top)}
    return ranks | {w: min(r, ranks.get(w, r)) for w, r in RANK.items()}


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with every maximal stretch of overlapping or touching spans replaced by ``mark``."""
    out, at, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a > end:
            if end >= 0:
                out.append(mark)
                at = end
            out.append(text[at:a])
        end = max(end, b)
    if end < 0:
        return text
    return "".join([*out, mark, text[end:]])


def scan_documents(docs: DataFrame, text: str = "text", min_bits: float = 40.0, ranks: dict[str, int] | None = None) -> DataFrame:
    """Adds ``n_assign, n_access, n_hex, base_sha256, spans`` (they replace columns of these names).

    A value in a credential's place adds a ``guess`` span if guessing it takes ``min_bits``
    bits or more, with the words of ``ranks``, learned from all of ``docs`` if none are given
    (``learn_ranks``: one row per distinct word and task is shuffled, at most ``MOST_WORDS``
    words reach the driver and the tasks). The scan itself moves nothing. Null texts count
    as empty, rows that repeat or tie are scanned alike, an empty table gives an empty one.
    """
    shipped = ship(docs.sparkSession).sparkContext.broadcast(learn_ranks(docs, text) if ranks is None else ranks)
    name = free_name(docs, "found")

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        guesser = Guesser(shipped.value)
        for part in parts:
            rows = []
            for t in part:
                spans = scan(t or "", min_bits, guesser)
                base = [s for s in spans if s[0] != "guess"]
                kinds = [s[0] for s in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in KINDS[:3]), digest, joined(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    added = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    rest = [c for c in docs.columns if c.lower() not in added]
    return docs.select(*rest, run.asNondeterministic()(F.col(text)).alias(name)).select(*rest, f"{name}.*")


def redact_documents(docs: DataFrame, text: str = "text", min_bits: float = 40.0, mark: str = "[secret]", ranks: dict[str, int] | None = None) -> DataFrame:
    """The rows with all spans of ``text`` replaced by ``mark``; null texts stay null, rows and columns stay as they are.

    Words as in ``scan_documents``; repeated rows are treated alike, an empty table gives an empty one.
    """
    shipped = ship(docs.sparkSession).sparkContext.broadcast(learn_ranks(docs, text) if ranks is None else ranks)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        guesser = Guesser(shipped.value)
        for part in parts:
            yield pd.Series([t if t is None else redact(t, scan(t, min_bits, guesser), mark) for t in part], dtype=object)

    return docs.withColumn(text, run.asNondeterministic()(F.col(text)))
