"""URL filters by logistic regression on hashed character n-grams (operator 12).

A url is cut into host and path. Rules of the form host/path, from a block and
allow list, come first: a rule fits its host and all subdomains where the path
starts with the rule's, and the longest that fits decides. Every other url is
judged by a logistic regression over the character n-grams of its host and of its
path, hashed into a table of fixed size, which is trained on a small table of
labelled urls. The weights, of fixed size, reach the tasks by broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMS = (3, 4, 5)        # lengths of the n-grams
BITS = 18                # of the hashed table
ROUNDS = 1000            # full gradient steps
RATE = 4.0
DECAY = 0.0001           # L2
PRIOR = 0.1              # weight of the urls to block in the fit, however many are labelled
THRESHOLD = 0.5          # probability from which a url is blocked
MAX_RULES = 100_000      # rules that a task may hold; more are refused
MAX_EXAMPLES = 100_000   # labelled urls that the driver may fit on; more are refused
REMEMBERED = 50_000      # hosts whose part of the sum a task remembers

# The labelled urls of the registered query: invented hosts of kinds that training
# corpora commonly leave out (medicine sales, gambling, adult, spam, advertising and
# tracking, malware, quick money), and of kinds they keep. Both stand with the same
# paths and prefixes, so that these tell nothing.
BLOCKED_HOSTS = """
    best-pills-online pills4you discount-pills-shop buycheapmeds cheap-meds cheaprx cheap-viagra pill-store
    casino-royal online-casino mycasino big-casino-bonus slots-win win-jackpot poker-casino casino-slots
    sportbets bets-online best-bets live-bets football-bets betting-tips bet-bonus free-spins free-betting
    adult-video adult-cams xxx-adult adult-dating porn-tube xxx-pics sexchat x-rated adult-chat
    spam-mail seo-spam spamlinks blog-spam bulk-spam link-farm content-farm article-farm backlink-farms
    ads-server adserver adtrack ads-popup banner-ads tracker-ads click-track ad-tracking pixel-track track-users
    malware-download free-crack warez-downloads phishing-login payday-loans quick-cash earn-money-fast get-rich-quick
"""
KEPT_HOSTS = """
    citynews harbour-news dailyherald weathernow encyclopedia wikiworld library museum university college school
    codelang gardeners traveller recipes kitchen cinema science journal government parliament hospital charity
    orchestra theatre mathnotes railways bookseller thehiker astronomy there villagelife oneanother stationery nation
    another-day the-history-blog music-theory open-data local-history photography hiking radio economics linguistics
    architecture garden-plants birdwatch cycling-club chess-club thinking handbook northern weather-station translation
    thread-and-needle tinsmith netherlands shortstories theorem trainspotting anthology ironworks
"""
PREFIXES = ("", "www.", "blog.", "m.")
ENDS = (".test", ".example.test")
PATHS = ("/", "/en/1042", "/fr/144.html", "/de/77654", "/es/380/", "/2024/05/first-post", "/index.html", "/about", "/item/33")
LABELLED = [(f"https://{prefix}{host}{ENDS[(i + k) % len(ENDS)]}{PATHS[(i + 2 * k) % len(PATHS)]}", block)
            for hosts, block in ((BLOCKED_HOSTS, True), (KEPT_HOSTS, False))
            for i, host in enumerate(hosts.split()) for k, prefix in enumerate(PREFIXES)]


def host_and_path(url: Column | str = "url") -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
    lower case; path: from there up to ``?``, ``#`` or the end. Both are empty for a
    null url and one without ``://``."""
    u = F.col(url) if isinstance(url, str) else url
    rest = F.substr(u, F.instr(u, "://") + 3)
    cut = F.when(F.instr(u, "://") > 0, rest).otherwise("")
    host = F.regexp_extract(cut, r"^[^/?#]*", 0)
    path = F.substring_index(F.substring_index(F.substr(cut, F.char_length(host) + 1), "?", 1), "#", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _hashed(kind: bytes, text: str) -> np.ndarray:
    """Cells of the n-grams of a host or a path, whose ends are marked; the same
    cell stands as often as its n-grams."""
    b = kind + text.encode("utf-8", "surrogatepass") + b"\n"
    return np.array([zlib.crc32(b[i:i + n], n) & ((1 << BITS) - 1) for n in GRAMS for i in range(len(b) - n + 1)], dtype=np.int64)


def _scaled(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells with weights of length 1."""
    ids = np.unique(cells)
    return ids, np.full(len(ids), 1 / np.sqrt(max(len(ids), 1)))


@dataclass
class Model:
    """Logistic regression over hashed n-grams: a part for the host, one for the
    path, and a bias."""
    weights: np.ndarray
    bias: float

    def part(self, kind: bytes, text: str) -> float:
        ids, v = _scaled(_hashed(kind, text))
        return float(self.weights[ids] @ v)

    def probability(self, host: float, path: float) -> float:
        return float(1 / (1 + np.exp(-(self.bias + host + path))))


def trained(examples: DataFrame, url_col: str = "url", label_col: str = "block", rounds: int = ROUNDS,
            prior: float = PRIOR) -> Model:
    """The model of a small labelled url table (``url_col``, ``label_col`` true for
    urls to block), which weigh ``prior`` in total, the others the rest. The fit is by
    full gradient steps over rows in order, so reruns agree. Rows without label are
    left out; with one label alone, or none, the model gives that label (or allows)
    always."""
    parts = host_and_path(url_col)
    rows = examples.where(F.col(label_col).isNotNull()).select(
        parts[0].alias("host"), parts[1].alias("path"), F.col(label_col).cast("boolean").alias("y")).limit(MAX_EXAMPLES + 1).collect()
    if len(rows) > MAX_EXAMPLES:
        raise ValueError(f"more than {MAX_EXAMPLES} labelled urls: train on a sample of them")
    rows = sorted((r["host"], r["path"], r["y"]) for r in rows)
    y = np.array([r[2] for r in rows], dtype=np.float64)
    weights, bias = np.zeros(1 << BITS), 0.0
    if not len(y) or y.min() == y.max():
        return Model(weights, 20.0 if len(y) and y[0] else -20.0)
    at, ids, values = [], [], []
    for i, (host, path, _) in enumerate(rows):
        for kind, text in ((b"h", host), (b"p", path)):
            c, v = _scaled(_hashed(kind, text))
            at.append(np.full(len(c), i))
            ids.append(c)
            values.append(v)
    at, ids, values = map(np.concatenate, (at, ids, values))
    share = np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum()))
    for _ in range(rounds):
        z = np.bincount(at, weights[ids] * values, len(y)) + bias
        gap = share * (1 / (1 + np.exp(-z)) - y)
        weights -= RATE * (np.bincount(ids, gap[at] * values, len(weights)) + DECAY * weights)
        bias -= RATE * float(gap.sum())
    return Model(weights, bias)


def _rules_by_host(rules: DataFrame) -> dict[str, list[tuple[str, str]]]:
    """Host -> (path, verdict) of its rules, longest path first; of equal rules with
    both verdicts ``block`` stands."""
    rows = rules.where("rule is not null and verdict is not null").select("rule", "verdict").distinct().limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    by: dict[str, dict[str, str]] = {}
    for rule, verdict in sorted(tuple(r) for r in rows):
        host, slash, path = rule.partition("/")
        by.setdefault(host.lower(), {})[slash + path] = verdict
    return {h: sorted(p.items(), key=lambda x: (-len(x[0]), x)) for h, p in by.items()}


def fitting_rule(rules: dict[str, list[tuple[str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule, in characters, that fits; ties go to the
    longer host, the nearer one."""
    best, at = None, 0
    while True:
        suffix = host[at:]
        for start, verdict in rules.get(suffix, ()):
            if path.startswith(start):
                if best is None or len(suffix) + len(start) > len(best[0]):
                    best = (suffix + start, verdict)
                break
        dot = host.find(".", at)
        if dot < 0:
            return best
        at = dot + 1


def judge(pages: DataFrame, rules: DataFrame, examples: DataFrame, url_col: str = "url", id_col: str = "page_id",
          threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, host, path, rule, verdict, score) of every row of ``pages``.

    ``rules`` (rule, verdict: allow or block): at most ``MAX_RULES``; ``examples``
    (url, block): at most ``MAX_EXAMPLES``. ``verdict`` is the fitting rule's, else
    block where ``score``, the model's probability, reaches ``threshold``. Repeated
    rows and ids give a row each; a null url has empty host and path and is judged
    by the model as such; urls count whole, however long. An empty table gives no
    rows, empty rules and examples allow all. Nothing is shuffled and no column but
    the two is read."""
    spark = pages.sparkSession
    fitted = trained(examples)
    held = spark.sparkContext.broadcast((_rules_by_host(rules), fitted.weights, fitted.bias))   # plain values

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, weights, bias = held.value
        model = Model(weights, bias)
        known: dict[str, float] = {}
        for batch in batches:
            rule, verdict, score = [], [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                part = known.get(host)
                if part is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    part = known[host] = model.part(b"h", host)
                s = model.probability(part, model.part(b"p", path))
                fit = fitting_rule(by, host, path)
                rule.append(fit and fit[0])
                verdict.append(fit[1] if fit else "block" if s >= threshold else "allow")
                score.append(s)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(score, pa.float64())],
                names=["id", "host", "path", "rule", "verdict", "score"])

    host, path = host_and_path(url_col)
    kind = pages.schema[id_col].dataType.simpleString()
    made = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).mapInArrow(
        work, f"id {kind}, host string, path string, rule string, verdict string, score double")
    return made.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "score")
