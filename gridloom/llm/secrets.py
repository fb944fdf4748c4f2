"""Operator 4: secret scans by grammar inference.

Base patterns give the sure spans. Beyond them, a probabilistic automaton of credential formats is
inferred from labelled credentials, and one of ordinary tokens from tokens beside them: each starts as a
prefix tree, whose states merge where a Hoeffding test finds their continuations compatible; of several
such states the one that explains the merged strings best is taken, and a state seen too rarely for the
test joins the best of all. Every candidate token of every text is then scored by how much likelier its
format is as a credential, and those above the calibrated threshold are added as spans of kind "format".
Long tokens are scored along their whole length, in overlapping pieces; the likeliest piece decides.

A token's format is the sequence of its characters' classes; a prefix that many labelled tokens share
stands in it as a symbol of its own, so that `ghp_` is not any three letters and an underscore.

Labelled credentials are the base patterns' values in a bounded sample of documents, and examples of
public formats made by rule (FORMATS). The ordinary ones are made by rule too (ORDINARY), and tokens of
the sample outside base spans join them unless they look like credentials. The threshold is a quantile
over the ordinary candidates of all documents, each as often as it stands there, and over made ones that
no automaton learned from.

Defined cases: a null text counts as empty; a text without matches has counts 0 and the hash of the
empty string; texts that repeat have equal spans; an empty table gives no rows (the automata then come
from FORMATS and ORDINARY alone); other columns pass through `scan` (those of the added names are replaced).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, first_by_hash, tune, with_added

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
#: Candidates: tokens of this alphabet that are long, or shorter but hold a digit.
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
LONG, SHORT = 16, 8
_LONG, _DIGITS = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LONG), re.compile(r"[0-9]+")
#: Documents of the training sample (the first in hash order of doc_id), and values of each kind taken from them.
SAMPLE_DOCS, SAMPLE_VALUES = 4000, 1500
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Public credential formats as (text, or (alphabet, length)) parts, by which labelled examples are made.
FORMATS = (
    ("ghp_", (BASE62, 36)), ("npm_", (BASE62, 36)), ("glpat-", (BASE62 + "-_", 20)), ("sk_live_", (BASE62, 24)),
    ("xoxb-", (BASE62[52:], 12), "-", (BASE62[52:], 12), "-", (BASE62, 24)), ("AIza", (BASE62 + "-_", 35)), ("SG.", (BASE62 + "-_", 22), ".", (BASE62 + "-_", 43)),
    ("eyJ", (BASE62 + "-_", 33), ".eyJ", (BASE62 + "-_", 60), ".", (BASE62 + "-_", 43)), ((BASE62 + "+/", 40),), ((BASE62, 32),),
)
#: Examples of each format, and of each ordinary kind.
EXAMPLES = 200
#: A prefix is a symbol if it has so many characters, and so many labelled tokens of one side start with it.
PREFIX, PREFIX_SEEN = (3, 8), 12
#: Confidence of the merge test, and the least number of strings that a state needs to be tested.
ALPHA, LEAST_SEEN = 0.05, 8
#: Steps of merged strings after which the choice between fitting states is made.
MOST_STEPS = 20_000
#: A format is added if its log-likelihood ratio is above that of all but this share of the other tokens, and of MIN_RATIO.
FALSE_SHARE, MIN_RATIO = 0.005, 15.0
#: Width of the bins in which ratios are counted.
BIN = 0.25
#: A longer token is judged in pieces of this length, each half over the one before, the last one ending with the token.
PIECE = 256
#: Verdicts of pieces that a task keeps, for speed only.
CACHE = 200_000
#: Ends a piece where the token goes on.
OPEN = "\n"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost without overlaps in each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def tokens(text: str):
    """(start, end) of the candidate tokens, in order."""
    done = 0
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        if a < done:
            continue
        yield from ((x.start(), x.end()) for x in _LONG.finditer(text, done, a) if x.end() < a or text[a - 1] not in TOKEN)
        while a > done and text[a - 1] in TOKEN:
            a -= 1
        while b < len(text) and text[b] in TOKEN:
            b += 1
        if b - a >= SHORT:
            yield a, b
        done = b
    yield from ((x.start(), x.end()) for x in _LONG.finditer(text, done))


def candidates(text: str, spans: list[tuple[int, int, int]]):
    """Candidate tokens outside the base spans (sorted by start), both read once in order."""
    k, reach = 0, 0  # reach: the end of the spans that start before the token's end
    for a, b in tokens(text):
        while k < len(spans) and spans[k][0] < b:
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= a:
            yield a, b


_CLASS = {**dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "z"), **dict.fromkeys("ABCDEF", "A"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "Z"), **dict.fromkeys("0123456789", "9")}
_SHAPE = str.maketrans(_CLASS)
CLASSES = "azAZ9+/_.=-"


def frequent_prefixes(strings: list[str]) -> list[str]:
    """Prefixes that many strings share, each grown as long as at least half of its strings go on alike."""
    count = Counter(s[:n] for s in set(strings) for n in range(PREFIX[0], PREFIX[1] + 1) if len(s) > n)
    grown: dict[str, str] = {p[:-1]: p for p, n in sorted(count.items()) if len(p) > PREFIX[0] and 2 * n >= count[p[:-1]]}
    out = set()
    for p, n in count.items():
        if len(p) == PREFIX[0] and n >= PREFIX_SEEN:
            while count[grown.get(p, "")] >= PREFIX_SEEN:
                p = grown[p]
            out.add(p)
    return sorted(out)


class Shapes:
    """Tokens to formats: a known prefix (the longest that fits) as a symbol of its own, then the characters' classes."""

    def __init__(self, prefixes: list[str] = ()):
        self.symbols = {p: chr(0xE000 + k) for k, p in enumerate(sorted(prefixes))}
        self.lengths = sorted({len(p) for p in self.symbols}, reverse=True)
        self.choices = len(CLASSES) + len(self.symbols) + 1

    def __call__(self, token: str) -> str:
        for n in self.lengths:
            symbol = self.symbols.get(token[:n])
            if symbol:
                return symbol + token[n:].translate(_SHAPE)
        return token.translate(_SHAPE)


def pieces(s: str) -> list[str]:
    """The whole shape in distinct pieces of a bounded size."""
    if len(s) <= PIECE:
        return [s]
    return list(dict.fromkeys([*(s[i : i + PIECE] + OPEN for i in range(0, len(s) - PIECE, PIECE // 2)), s[-PIECE:]]))


class Automaton:
    """A probabilistic automaton inferred from strings by state merging."""

    def __init__(self, strings: list[str], alpha: float = ALPHA, choices: int = len(CLASSES) + 1):
        self.choices = choices
        self.n, self.end, self.go, self.count = [0], [0], [{}], [{}]
        for s in strings:
            at = 0
            self.n[0] += 1
            ends = not s.endswith(OPEN)
            for c in s if ends else s[:-1]:
                nxt = self.go[at].get(c)
                if nxt is None:
                    nxt = self.go[at][c] = len(self.n)
                    self.n.append(0)
                    self.end.append(0)
                    self.go.append({})
                    self.count.append({})
                self.count[at][c] = self.count[at].get(c, 0) + 1
                at = nxt
                self.n[at] += 1
            if ends:
                self.end[at] += 1
            else:
                self.n[at] -= 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no state below the two that was seen often enough differs."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.n[a], self.n[b]
            if min(na, nb) < LEAST_SEEN:
                continue
            if self._differ(self.end[a], na, self.end[b], nb):
                return False
            for c in {*self.count[a], *self.count[b]}:
                if self._differ(self.count[a].get(c, 0), na, self.count[b].get(c, 0), nb):
                    return False
                if c in self.go[a] and c in self.go[b]:
                    todo.append((self.go[a][c], self.go[b][c]))
        return True

    def _explained(self, a: int, b: int) -> float:
        """How well state a explains the strings below b: their log-likelihood by step, if they went on from a."""
        total, steps, todo = 0.0, 0, [(a, b)]
        while todo:
            a, b = todo.pop()
            whole = self.n[a] + 0.1 * self.choices
            for c, n in self.count[b].items():
                total += n * math.log((self.count[a].get(c, 0) + 0.1) / whole)
                todo.append((self.go[a].get(c, 0), self.go[b][c]))
            if self.end[b]:
                total += self.end[b] * math.log((self.end[a] + 0.1) / whole)
            steps += self.n[b]
            if steps > MOST_STEPS:
                break  # evidence enough
        return total / max(steps, 1)

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.n[a] += self.n[b]
            self.end[a] += self.end[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.go[a]:
                    todo.append((self.go[a][c], self.go[b][c]))
                else:
                    self.go[a][c] = self.go[b][c]

    def _infer(self) -> None:
        red, known = [0], {0}
        while True:
            blue = [(-self.n[t], r, c, t) for r in red for c, t in self.go[r].items() if t not in known]
            if not blue:
                break
            _, r, c, t = min(blue)
            rare = self.n[t] < LEAST_SEEN
            fitting = [other for other in red if rare or self._compatible(other, t)]
            if fitting:
                best = max(fitting, key=lambda other: (self._explained(other, t), -other))
                self.go[r][c] = best
                self._fold(best, t)
            else:
                red.append(t)
                known.add(t)
        self.states = len(red)

    def score(self, s: str) -> float:
        """Log-likelihood, smoothed: a step never seen leads to the start at the smallest probability. A piece that goes on has no end."""
        at, total, choices = 0, 0.0, self.choices
        for c in s:
            if c == OPEN:
                return total
            total += math.log((self.count[at].get(c, 0) + 0.1) / (self.n[at] + 0.1 * choices))
            at = self.go[at].get(c, 0)
        return total + math.log((self.end[at] + 0.1) / (self.n[at] + 0.1 * choices))


class Scorer:
    """The two automata and the threshold.

    others are known to be ordinary, and held are more of them that only set the threshold. Of unlabelled
    tokens, those that the credential automaton prefers to one of the known others are taken for
    credentials without a label: they neither teach the automaton of others nor move the threshold.
    """

    def __init__(self, credentials: list[str], others: list[str], held: list[str] = (), unlabelled: list[str] = ()):
        self.shape = Shapes({*frequent_prefixes(credentials), *frequent_prefixes(others)})
        infer = lambda tokens: Automaton([x for t in tokens for x in pieces(self.shape(t))], choices=self.shape.choices)
        self.credential, self.known = infer(credentials), infer(others)
        kept = [t for t in unlabelled if all(self.ordinary(x) for x in pieces(self.shape(t)))]
        self.other = infer([*others, *kept]) if kept else self.known
        self.bins = Counter(max(self.bin(x) for x in pieces(self.shape(t))) for t in held or others)
        self.calibrate({})

    def ordinary(self, s: str) -> bool:
        return self.credential.score(s) - self.known.score(s) <= MIN_RATIO

    def bin(self, s: str) -> int:
        return math.floor(self.ratio(s) / BIN)

    def calibrate(self, bins: dict[int, int]) -> None:
        """Sets the threshold above all but FALSE_SHARE of the held tokens, and of all ordinary tokens, counted by bin."""
        self.threshold = MIN_RATIO
        for count in (self.bins, Counter(bins)):
            left = FALSE_SHARE * count.total()
            for k in sorted(count, reverse=True):
                left -= count[k]
                if left < 0:
                    self.threshold = max(self.threshold, (k + 1) * BIN)
                    break

    def ratio(self, s: str) -> float:
        return self.credential.score(s) - self.other.score(s)

    def secret(self, token: str) -> bool:
        return any(self.ratio(x) > self.threshold for x in pieces(self.shape(token)))


def credential_examples(seed: int, n: int = EXAMPLES) -> dict[int, list[str]]:
    """Tokens of each of FORMATS, by its number."""
    rng = random.Random(seed)
    part = lambda p: p if isinstance(p, str) else "".join(rng.choice(p[0]) for _ in range(p[1]))
    return {k: ["".join(map(part, form)) for _ in range(n)] for k, form in enumerate(FORMATS)}


def ordinary_examples(seed: int, n: int = EXAMPLES) -> dict[str, list[str]]:
    """Ordinary tokens of each kind, made by rule."""
    rng = random.Random(seed)
    low, up, digits = BASE62[26:52], BASE62[:26], BASE62[52:]
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    # words of consonants and vowels by turns, as languages have them
    word = lambda a=2, b=5: "".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s", "t"]) for _ in range(rng.randint(a, b)))
    joined = lambda by, a, b, f=word: by.join(f() for _ in range(rng.randint(a, b)))
    camel = lambda: "".join(word(1, 3).capitalize() for _ in range(rng.randint(2, 6)))
    day = lambda: f"{rng.randint(1950, 2049)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    number = lambda k: str(rng.randint(0, 10**k))
    hexed = lambda alphabet, *sizes: "-".join(pick(alphabet, k) for k in sizes)
    kinds = {
        "number": lambda: pick(digits, rng.randint(8, 24)), "phone": lambda: "-".join(pick(digits, k) for k in rng.choice([(3, 4), (3, 3, 4), (2, 4, 6)])), "address": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "date": lambda: day() + rng.choice(["", f"T{rng.randint(0, 23):02}", f"_{word()}", f"-{word()}.{word(1, 1)}"]), "version": lambda: f"{word()}-{number(1)}.{number(2)}.{number(2)}" + rng.choice(["", "-rc1", ".tar.gz", "-beta.2"]), "decimal": lambda: f"{number(6)}.{pick(digits, rng.randint(4, 12))}",
        "uuid": lambda: hexed("0123456789abcdef", 8, 4, 4, 4, 12), "upper uuid": lambda: hexed("0123456789ABCDEF", 8, 4, 4, 4, 12), "digest": lambda: pick("0123456789ABCDEF", rng.choice([32, 40, 64])), "short digest": lambda: pick("0123456789abcdef", rng.choice([8, 12, 16, 20])),
        "integrity": lambda: "sha256-" + pick(BASE62 + "+/", 43) + "=", "camel": camel, "camel with number": lambda: camel() + number(3), "lower camel": lambda: word() + camel(), "snake": lambda: joined("_", 2, 6), "snake with number": lambda: joined("_", 2, 5) + f"_{number(4)}", "upper snake": lambda: joined("_", 2, 5).upper(), "kebab": lambda: joined("-", 2, 7), "dotted": lambda: joined(".", 2, 6),
        "path": lambda: rng.choice(["/", ""]) + joined("/", 2, 7) + rng.choice(["", ".py", ".html", f"{number(2)}.txt", "/"]), "path with numbers": lambda: joined("/", 2, 4) + f"/{number(6)}/{word()}{number(2)}", "host": lambda: f"{rng.choice(['www', 'mail', 'm'])}{rng.choice(['', number(1)])}.{word()}.{rng.choice(['com', 'org', 'net'])}", "camel path": lambda: joined("/", 2, 4, camel),
        "word": lambda: joined("", 2, 4), "upper word": lambda: joined("", 2, 4).upper() + rng.choice(["", "."]), "capital word": lambda: joined("", 2, 4).capitalize() + rng.choice(["", "."]), "letters": lambda: pick(low, rng.randint(16, 30)), "upper letters": lambda: pick(up, rng.randint(16, 30)), "word with number": lambda: word() + number(4) + rng.choice(["", word()]), "line": lambda: rng.choice("=-._") * rng.randint(16, 80), "part number": lambda: f"{pick(up, 3)}-{pick(digits, 5)}-{pick(up, 1)}{pick(digits, 2)}", "sum": lambda: f"{number(5)}+{number(5)}={number(6)}",
    }
    return {kind: [t for t in (f() for _ in range(n)) if len(t) >= SHORT] for kind, f in kinds.items()}


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_values: int = SAMPLE_VALUES) -> Scorer:
    tune(docs.sparkSession)
    ids = first_by_hash(docs.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", sample_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text")

    def collect(batches):
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                text = text or ""
                spans = base_spans(text)
                for a, kind, b in spans:
                    rows.append((text[a:b] if kind else ASSIGN.match(text, a).group(1), True))
                rows += [(text[a:b], False) for a, b in candidates(text, spans)]
            cols = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_())], names=["token", "credential"])

    # by hash order, so that a bounded number of each kind reaches the driver
    found = cut(sample.mapInArrow(collect, "token string, credential boolean").distinct())
    take = lambda flag: [r["token"] for r in first_by_hash(found.where(F.col("credential") == flag), "token", sample_values).collect()]
    flat = lambda kinds: [t for tokens in kinds.values() for t in tokens]
    scorer = Scorer([*flat(credential_examples(1)), *take(True)], flat(ordinary_examples(2)), flat(ordinary_examples(3)), take(False))
    scorer.calibrate(ordinary_bins(docs, scorer))
    return scorer


def ordinary_bins(docs: DataFrame, scorer: Scorer) -> dict[int, int]:
    """How many ordinary candidate tokens of all documents have a ratio in each bin; a token has that of its likeliest piece."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def count(batches):
        model = shared.value
        seen: dict[str, int | None] = {}
        bins: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                text = text or ""
                for a, b in candidates(text, base_spans(text)):
                    own = []
                    for s in pieces(model.shape(text[a:b])):
                        if s not in seen:
                            if len(seen) > CACHE:
                                seen.clear()
                            seen[s] = model.bin(s) if model.ordinary(s) else None
                        own.append(seen[s])
                    if None not in own:
                        bins[max(own)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(bins), pa.int64()), pa.array(list(bins.values()), pa.int64())], names=["bin", "n"])

    counted = docs.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    return {r["bin"]: r["n"] for r in counted.collect()}


def scan(docs: DataFrame, keep: list[str] | None = None, scorer: Scorer | None = None) -> DataFrame:
    """docs' columns (or those in keep) with n_assign, n_access, n_hex, n_format, base_sha256, spans."""
    spark = docs.sparkSession
    tune(spark)
    scorer = scorer or train(docs)
    keep = docs.columns if keep is None else keep
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches):
        model = shared.value
        seen: dict[str, bool] = {}
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = []
                for a, b in candidates(text, base):
                    for s in pieces(model.shape(text[a:b])):
                        hit = seen.get(s)
                        if hit is None:
                            if len(seen) > CACHE:
                                seen.clear()
                            hit = seen[s] = model.ratio(s) > model.threshold
                        if hit:
                            more.append((a, 3, b))
                            break
                n = Counter(k for _, k, _ in base)
                say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                rows.append((n[0], n[1], n[2], len(more), hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + more))))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(),) * 4 + (pa.string(),) * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*batch.schema.names[:-1], "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"])

    given = docs.select(*[docs[c].alias(f"in_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "_text"] + ["n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string"])
    out = given.mapInArrow(run, schema)
    return with_added(out, keep, out.columns[len(keep) :])
