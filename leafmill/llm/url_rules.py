"""URL filters: rules indexed by their rarest literal token; only the candidates a URL's tokens fetch run as expressions."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import free_name, ship

ALLOW, BLOCK = "allow", "block"
#: The rules travel to every task; more than so many are refused.
MOST_RULES = 500_000
TOKEN = re.compile("[a-z0-9]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
#: What may stand in place of ``^`` in a pattern.
SEPARATOR = r"(?:[^0-9a-z_.%-]|\Z)"
HOST_START = r"^//(?:[^/?#]*\.)?"


@dataclass(frozen=True)
class Rule:
    """``regex`` runs on ``//host rest`` of a URL, host in lower case; for patterns all of it is in lower case."""

    name: str
    verdict: str
    regex: str
    is_site: bool
    tokens: tuple[str, ...]


def _bounded_tokens(text: str, opens: bool, closes: bool) -> list[str]:
    """Tokens of a literal that are whole tokens of any URL which holds it; ``opens``, ``closes``: nothing of a token can stand beside it."""
    out = []
    for m in TOKEN.finditer(text):
        if (m.start() or opens) and (m.end() < len(text) or closes):
            out.append(m.group())
    return out


def site_rule(name: str, verdict: str) -> Rule:
    """``host/path``: holds for the host and its subdomains where the URL's path starts with the rule's."""
    host, _, path = name.partition("/")
    tokens = _bounded_tokens(f"{host}/{path}".translate(_FOLD), True, False)
    return Rule(name, verdict, f"{HOST_START}{re.escape(host.translate(_FOLD))}/{re.escape(path)}", True, tuple(dict.fromkeys(tokens)))


def pattern_rule(text: str) -> Rule:
    """A rule in the syntax of public filter lists, letters in either case.

    ``||`` stands for the start of a host or subdomain, ``|`` at an end for that end of the
    address, ``^`` for a separator or the end, ``*`` for anything; ``@@`` in front allows
    instead of blocks.
    """
    body = text.translate(_FOLD)
    verdict = ALLOW if body.startswith("@@") else BLOCK
    body = body.removeprefix("@@")
    opens, closes, regex = False, False, ""
    if body.startswith("||"):
        body, regex, opens = body[2:], HOST_START, True
    elif body.startswith("|"):
        body, regex, opens = body[1:], "^//", True
    if body.endswith("|"):
        body, closes = body[:-1], True
    tokens: list[str] = []
    pieces = re.split(r"([*^])", body)
    for i, piece in enumerate(pieces):
        if piece == "*":
            regex += r"[\s\S]*"
        elif piece == "^":
            regex += SEPARATOR
        elif piece:
            before = opens if i == 0 else pieces[i - 1] == "^"
            after = closes if i == len(pieces) - 1 else pieces[i + 1] == "^"
            tokens += _bounded_tokens(piece, before, after)
            regex += re.escape(piece)
    return Rule(text, verdict, regex + (r"\Z" if closes else ""), False, tuple(dict.fromkeys(tokens)))


#: Site rules of the query.
SITES = (site_rule("net/", BLOCK), site_rule("example.net/en/", ALLOW), site_rule("example.com/de/", BLOCK), site_rule("org/fr/", ALLOW))
#: Patterns of the query where no site rule holds: a short list of the usual kinds; a production list is passed in its place.
PATTERNS = tuple(
    map(
        pattern_rule,
        (
            "^ads-track^", "||ads-track.", "||doubleclick.", "||adserver.", "/adserver/", "/banners/", "/popup/", "^sponsored^", "/affiliate/", "?affid=",
            "/login^", "/signin^", "/logout^", "/register^", "/cart^", "/checkout^", "/wp-login.", "/wp-admin/", "/cgi-bin/", "/search?", "^sessionid=",
            "/casino/", "||casino.", "/porn/", "||porn.", "@@||archive.*/search?", "@@/banners/history/",
        ),
    )
)


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z in lower case), path, and all that follows the host; empty for null and without ``://``."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", "", ""
    m = re.match(r"([^/?#]*)(([^?#]*)[\s\S]*)", url[at + 3 :])
    return m.group(1).translate(_FOLD), m.group(3), m.group(2)


def tokens_of(host: str, rest: str) -> set[str]:
    return set(TOKEN.findall(f"{host} {rest.translate(_FOLD)}"))


class RuleIndex:
    """Rules by their rarest token. Rules without a whole token are candidates of every URL."""

    def __init__(self, rules: Sequence[Rule], seen: dict[str, int]):
        self.rules = list(rules)
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, rule in enumerate(self.rules):
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (seen.get(t, 0), -len(t), t))
                self.by_token.setdefault(rarest, []).append(i)
            else:
                self.always.append(i)
        self._compiled: dict[int, re.Pattern] = {}

    def __getstate__(self):
        return {**self.__dict__, "_compiled": {}}

    def _holds(self, i: int, address: str, folded: str) -> bool:
        found = self._compiled.get(i)
        if found is None:
            found = self._compiled[i] = re.compile(self.rules[i].regex)
        return found.search(address if self.rules[i].is_site else folded) is not None

    def candidates(self, host: str, rest: str) -> list[int]:
        return [*self.always, *(i for t in tokens_of(host, rest) for i in self.by_token.get(t, ()))]

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """Host, path, site rule, verdict, pattern: the longest site rule decides, else patterns that allow, else those that block, else allow."""
        host, path, rest = split_url(url)
        address = f"//{host}{rest}"
        folded = address.translate(_FOLD)
        found = self.candidates(host, rest)
        order = lambda i: (-len(self.rules[i].name), self.rules[i].name, i)
        for i in sorted((i for i in found if self.rules[i].is_site), key=order):
            if self._holds(i, address, folded):
                return host, path, self.rules[i].name, self.rules[i].verdict, None
        patterns = sorted((i for i in found if not self.rules[i].is_site), key=lambda i: (self.rules[i].verdict != ALLOW, *order(i)))
        for i in patterns:
            if self._holds(i, address, folded):
                return host, path, None, self.rules[i].verdict, self.rules[i].name
        return host, path, None, ALLOW, None


def token_counts(pages: DataFrame, url: str, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many URLs each token of the rules stands; as many numbers as the rules have tokens."""
    wanted = {t for r in rules for t in r.tokens}

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for part in parts:
            for u in part["url"]:
                host, _, rest = split_url(u)
                seen.update(wanted & tokens_of(host, rest))
        yield pd.DataFrame(list(seen.items()), columns=["token", "n"])

    counted = pages.select(F.col(url).alias("url")).mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Adds ``host, path, rule, verdict, pattern`` (replacing columns of these names).

    A first pass counts the rules' literal tokens over all URLs, and every rule is filed
    under its rarest one, so common tokens like ``com`` fetch nothing. In the second pass a
    URL's tokens fetch candidates and only these run. The longest site rule that holds
    gives the verdict; without one a pattern that allows, then one that blocks, then
    ``allow``. Of rules of one length the first by name, then the first given, decides. No row moves: rules are a
    list of at most ``MOST_RULES``, and Spark sends them to the tasks.

    Null URLs and those without ``://`` have empty host and path, no rule, and are allowed
    unless a pattern holds for the empty address. Repeated rows are judged alike, an empty
    table gives an empty one.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    ship(pages.sparkSession)
    index = RuleIndex(rules, token_counts(pages, url, rules))

    @F.pandas_udf("host string, path string, rule string, verdict string, pattern string")
    def run(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([index.judge(u) for u in urls], columns=["host", "path", "rule", "verdict", "pattern"], dtype=object)

    judged = free_name(pages, "judged")
    added = ("host", "path", "rule", "verdict", "pattern")
    rest = [c for c in pages.columns if c.lower() not in added]
    with_verdicts = pages.withColumn(judged, run.asNondeterministic()(F.col(url)))
    return with_verdicts.select(*rest, *[F.col(judged)[c].alias(c) for c in added])


def sql_twin(rules: Sequence[Rule]) -> str:
    """DuckDB SQL over ``pages`` that tries all rules on every URL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    order = lambda r: (-len(r.name), r.name)
    whens = {"rule": [], "site_verdict": [], "pattern": [], "pattern_verdict": []}
    for r in sorted((r for r in rules if r.is_site), key=order):
        host, _, path = r.name.partition("/")
        holds = f"(host = {quote(host)} or suffix(host, {quote('.' + host)})) and prefix(path, {quote('/' + path)})"
        whens["rule"].append(f"when {holds} then {quote(r.name)}")
        whens["site_verdict"].append(f"when {holds} then {quote(r.verdict)}")
    for r in sorted((r for r in rules if not r.is_site), key=lambda r: (r.verdict != ALLOW, *order(r))):
        holds = "regexp_matches(address, " + quote(r.regex.replace("\\Z", "$")) + ")"
        whens["pattern"].append(f"when {holds} then {quote(r.name)}")
        whens["pattern_verdict"].append(f"when {holds} then {quote(r.verdict)}")
    case = {k: f"case {' '.join(v)} end" for k, v in whens.items()}
    return f"""
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, '//' || translate(rest, '{UPPER}', '{LOWER}') as address from cut),
judged as (select *, {case["rule"]} as rule, {case["site_verdict"]} as site_verdict from parts)
select page_id, host, path, rule,
  case when rule is not null then site_verdict else coalesce({case["pattern_verdict"]}, 'allow') end as verdict,
  case when rule is null then {case["pattern"]} end as pattern
from judged
"""
