"""Quality rules on repetition, by a suffix array over the words of a text."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import SPACES, free_name, ship, split_words

SYMBOLS = "#*$%&|<>"
#: Words that texts are gathered to before they share one suffix array; only the number of array calls depends on it.
BATCH_WORDS = 60_000


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and, for each place in it, the longest common prefix with the place before.

    Doubling: ranks of the first word, then of 2, 4, 8 ... words; only suffixes that still
    tie take part in a round. The sparse ranks of every round are kept and give the common
    prefixes by binary steps. Memory is a few integers a word, and one more for each
    doubling for which a word's suffix still ties.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    sorted_ids = ids[order]
    starts = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]]) if n else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, n])
    rank[order] = np.repeat(starts, sizes)
    levels = []
    tied = np.flatnonzero(np.repeat(sizes, sizes) > 1)  # places in the array
    width = 1
    while len(tied):
        at = order[tied]
        levels.append((width, at.copy(), rank[at].copy()))
        second = rank[np.minimum(at + width, n)]
        first = rank[at]
        turn = np.lexsort((second, first))
        at, first, second = at[turn], first[turn], second[turn]
        order[tied] = at
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        begin = np.flatnonzero(new)
        group = np.diff(np.r_[begin, len(at)])
        rank[at] = np.repeat(tied[begin], group)
        tied = tied[np.repeat(group, group) > 1]
        width *= 2
    common = np.zeros(n, dtype=np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        length = np.zeros(n - 1, dtype=np.int64)
        dense = np.full(n + 1, -1, dtype=np.int64)
        for width, at, ranks in reversed(levels):
            dense[at] = ranks  # suffixes without a rank here tie with none
            ra, rb = dense[np.minimum(a, n)], dense[np.minimum(b, n)]
            same = (ra == rb) & (ra >= 0) & (a < n) & (b < n)
            length += width * same
            a += width * same
            b += width * same
            dense[at] = -1
        common[1:] = length
    return order, common


def repeated_spans(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: the length of the longest repeated run that starts there, and whether a maximal repeat of ``least`` words covers it.

    The two neighbours in the suffix array bound the common-prefix interval that a suffix
    lies in deepest; the larger of their common prefixes is the longest substring at that
    place that occurs elsewhere. The union of these spans is the union of all maximal repeats.
    """
    n = len(ids)
    order, common = suffix_array(ids)
    longest = np.zeros(n, dtype=np.int64)
    longest[order] = np.maximum(common, np.r_[common[1:], 0])
    start = np.flatnonzero(longest >= least)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + longest[start], -1)
    return longest, np.cumsum(edges[:n]) > 0


def in_repeated_windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Whether each word is in a window of ``size`` words that occurs twice or more."""
    n = len(ids) - size + 1
    covered = np.zeros(len(ids), dtype=bool)
    if n < 2:
        return covered
    key = ids[:n]
    for k in range(1, size):  # numbers of pairs, of triples ...: dense again after each step
        _, key = np.unique(key * np.int64(ids.max() + 1) + ids[k : k + n], return_inverse=True)
    twice = np.flatnonzero(np.bincount(key)[key] > 1)
    for k in range(size):
        covered[twice + k] = True
    return covered


def base_counts(text: str) -> tuple[int, int, int, int]:
    """Code points in words, symbols, repeated lines."""
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACES):
            seen.add(line)
    return chars, symbols, again


def measure(texts: list[str], least: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Words, characters in words, symbols, repeated lines, words in repeated 3-word windows, words under maximal repeats, longest repeat."""
    out: list = [None] * len(texts)
    batch: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        # each text has numbers of its own and a number of its own at its end: no repeat crosses texts
        parts, low = [], 0
        for _, ids in batch:
            parts.append(ids + low)
            low += (int(ids.max()) + 1) if len(ids) else 0
            parts.append(np.array([low], dtype=np.int64))
            low += 1
        if batch:
            whole = np.concatenate(parts)
            longest, covered = repeated_spans(whole, least)
            windows = in_repeated_windows(whole, 3)
        at = 0
        for i, ids in batch:
            end = at + len(ids)
            chars, symbols, again = base_counts(texts[i])
            out[i] = (
                len(ids), chars, symbols, again, int(windows[at:end].sum()), int(covered[at:end].sum()), int(longest[at:end].max(initial=0)),
            )
            at = end + 1
        batch.clear()
        held = 0

    for i, text in enumerate(texts):
        numbers: dict[bytes, int] = {}
        words = split_words(text)
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
        batch.append((i, ids))
        held += len(ids) + 1
        if held >= BATCH_WORDS:
            flush()
    flush()
    return out


def judge_documents(
    docs: DataFrame,
    text: str = "text",
    least: int = 8,
    max_share: float = 0.3,
    max_repeat: int = 60,
    min_words: int = 50,
    max_window_share: float = 0.5,
) -> DataFrame:
    """Adds the counts, ``n_covered``, ``longest_repeat``, ``base_failed`` and ``kept`` to every row.

    ``base_failed``: fewer than ``min_words`` words, or over ``max_window_share`` of them in
    3-word windows that occur twice. ``kept``: not failed, at most ``max_share`` of the words
    under repeats of ``least`` words or more, and no repeat longer than ``max_repeat`` words.
    Null texts have no words. Columns of the added names are replaced. No shuffle.
    """
    ship(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(measure([t or "" for t in part], least), columns=names)

    rest = [c for c in docs.columns if c.lower() not in (*names, "base_failed", "kept")]
    found = free_name(docs, "measured")
    measured = docs.select(*rest, run.asNondeterministic()(F.col(text)).alias(found)).select(*rest, f"{found}.*")
    words = F.col("n_words")
    failed = (words < min_words) | (F.col("n_repeat_words") > max_window_share * words)
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("n_covered") <= max_share * words) & (F.col("longest_repeat") <= max_repeat)
    )


SQL = r"""
with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (
  select r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w,
    generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i
  from texts),
grams as (
  select r, i, w,
    case when lead(w, 2) over p is not null then hash(w, lead(w, 1) over p, lead(w, 2) over p) end as g3,
    case when lead(w, 7) over p is not null then hash(list(w) over (partition by r order by i rows between current row and 7 following)) end as g8,
    case when lead(w, 60) over p is not null then hash(list(w) over (partition by r order by i rows between current row and 60 following)) end as g61
  from words window p as (partition by r order by i)),
twice as (
  select r, i,
    (g3 is not null and count(*) over (partition by r, g3) > 1)::int as t3,
    (g8 is not null and count(*) over (partition by r, g8) > 1)::int as t8,
    (g61 is not null and count(*) over (partition by r, g61) > 1)::int as t61
  from grams),
covered as (
  select r, max(t3) over (partition by r order by i rows between 2 preceding and current row) as c3,
    max(t8) over (partition by r order by i rows between 7 preceding and current row) as c8, t61
  from twice),
counts as (
  select r, count(*) as n_words, sum(c3)::bigint as n_repeat_words, sum(c8)::bigint as n_covered, max(t61) as too_long
  from covered group by r),
lines as (
  select r, (count(*) - count(distinct line))::bigint as n_dup_lines
  from (select r, unnest(string_split(text, chr(10))) as line from texts)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
joined as (
  select t.doc_id, coalesce(c.n_words, 0)::bigint as n_words,
    length(regexp_replace(t.text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(l.n_dup_lines, 0)::bigint as n_dup_lines, coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(c.n_covered, 0)::bigint as n_covered, coalesce(c.too_long, 0) as too_long
  from texts t left join counts c using (r) left join lines l using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_covered <= 0.3::double * n_words and too_long = 0 as kept
from joined
"""
