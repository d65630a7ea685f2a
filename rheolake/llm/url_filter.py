"""URL filtering: host/path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A vocabulary term counts where it stands between boundaries: neither neighbour may be an ASCII letter or digit.  Terms
have weights, and a url whose distinct terms weigh ``LIMIT`` together is blocked: a strict term weighs that alone, a soft
one half of it, so one strict or two distinct soft terms do.  Another vocabulary can be read from a table of terms and
weights (``read_vocabulary``).  All work is one narrow pass over (id, url).

Defined cases: a null url, or one without ``://``, has an empty host and path, so no rule fits it; its verdict is the
vocabulary's over what text there is (null: allow).  Equal rows get equal verdicts, urls of any length are read whole, an
empty table gives an empty result, and other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Fixed word lists.  Words of query strings and shops (ref, track, click, free) are left out: any site has them.
STRICT_TERMS = (
    "camgirl", "camgirls", "hentai", "keygen", "milf", "porn", "porno", "pornstar", "warez", "xxx", "xxxvideos",
)
SOFT_TERMS = (
    "adult", "bet", "betting", "blackjack", "bonus", "casino", "cheap", "cialis", "crack", "dating", "erotic", "escort", "escorts", "fetish", "gambling",
    "hookup", "jackpot", "lingerie", "loan", "loans", "lottery", "naked", "nude", "nudes", "payday", "pills", "poker", "replica", "roulette", "sex", "sexy",
    "slots", "sportsbook", "stripper", "torrent", "torrents", "viagra", "win",
)
LIMIT = 1.0
WEIGHTS = {**dict.fromkeys(SOFT_TERMS, LIMIT / 2), **dict.fromkeys(STRICT_TERMS, LIMIT)}
#: Terms of a vocabulary table at most; they go to every task.
MAX_TERMS = 200_000
SCHEMA = "host string, path string, rule string, verdict string, n_terms int, weight double"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path, as the module's text defines them."""
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return ascii_lower(host), rest[:end]


_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


class RuleBook:
    """Rules by host; a url asks for its own host and each of that host's parent domains."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest fitting rule (characters of host and path; at a tie the longer host, then the earlier rule)."""
        best, found, domain = (-1, -1), (None, None), host
        while True:
            for prefix, verdict in self.by_host.get(domain, ()):
                size = (len(domain) + len(prefix), len(domain))
                if path.startswith(prefix) and size > best:
                    best, found = size, (domain + prefix, verdict)
            _, dot, domain = domain.partition(".")
            if not dot:
                return found


def read_vocabulary(terms: DataFrame, max_terms: int = MAX_TERMS) -> dict[str, float]:
    """terms(term, weight) as a dictionary: A-Z lower-cased, the largest weight of equal terms, no empty ones."""
    rows = terms.where("term <> '' AND weight > 0").limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        raise ValueError(f"more than {max_terms} terms")
    found: dict[str, float] = {}
    for r in rows:
        term = ascii_lower(r["term"])
        found[term] = max(found.get(term, 0.0), float(r["weight"]))
    return found


def term_counter(weights: Mapping[str, float]):
    """A function from lower-cased text to (distinct terms found, their weight)."""
    import ahocorasick

    words = ahocorasick.Automaton()
    for term in weights:
        words.add_word(term, term)
    words.make_automaton()
    inner = set("abcdefghijklmnopqrstuvwxyz0123456789")

    def count(text: str) -> tuple[int, float]:
        found, n = set(), len(text)
        for end, term in words.iter(text):
            start = end - len(term)
            if not ((start >= 0 and text[start] in inner) or (end + 1 < n and text[end + 1] in inner)):
                found.add(term)
        return len(found), sum(weights[t] for t in sorted(found))

    return count


def url_verdicts(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    weights: Mapping[str, float] = WEIGHTS,
    limit: float = LIMIT,
) -> DataFrame:
    """One row per input row: id, url, host, path, rule, verdict, n_terms, weight."""
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    id_type = rows.schema[0].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, count = RuleBook(rules), term_counter(weights)
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = book.find(host, path)
                n_terms, weight = count(ascii_lower(url)) if url and weights else (0, 0.0)
                if verdict is None:
                    verdict = "block" if weight >= limit else "allow"
                out.append((host, path, rule, verdict, n_terms, weight))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)]
                + [pa.array(c, (pa.string(), pa.int32(), pa.float64())[max(0, i - 3)]) for i, c in enumerate(columns)],
                [id_col, "url", "host", "path", "rule", "verdict", "n_terms", "weight"],
            )

    return rows.mapInArrow(judge, f"`{id_col}` {id_type}, url string, {SCHEMA}")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    from rheolake.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    hits = lambda xs: (
        f"len(list_filter({terms(xs)}, lambda x: regexp_matches(low, '(^|[^a-z0-9])' || x || '($|[^a-z0-9])')))"
    )
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {rules}),
cut AS (
  SELECT page_id, url, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
keyed AS (SELECT *, row_number() OVER () AS rid FROM parts),
fit AS (
  SELECT rid, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS rn
  FROM keyed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule,
  coalesce(rverdict, CASE WHEN {hits(STRICT_TERMS)} >= 1 OR {hits(SOFT_TERMS)} >= 2
    THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed LEFT JOIN (SELECT * FROM fit WHERE rn = 1) USING (rid)
"""


SQL = _sql()
