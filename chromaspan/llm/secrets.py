"""Secret scan: pattern candidates, values assigned to names with a cue in them, and a random forest that removes false positives.

Candidates are taken widely: also numbers and long words are some.  The forest judges a candidate
by its length, its character transitions (changes of class, and how likely its letters follow one
another in the dictionary), how much of it dictionary words cover, its path and the words beside it.
It is trained on labelled findings; without any it uses findings made by a rule.
"""

from __future__ import annotations

import json
import re
import random
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts, small_batches, text_or_empty

# Words that long identifiers, addresses and prose are made of.
WORDS = """about after all and are but can com config data dev doc docs does each else error example false file for from get has
have hello home host html http https image info into item json key lib like list local log mail main make module name new none
not null number org out page path post public read return run server set site size some src string sub test text that the then
there they this time tion ing type update use user value was web what when which will with world would www you your""".split()
CUES = re.compile(r"(?i)token|secret|passw|pwd|api[_ -]?key|access[_ -]?key|private|credential|auth|bearer|client[_ -]?id|signature")
DOUBTS = re.compile(r"(?i)example|sample|dummy|fake|placeholder|sha-?\d|md5|checksum|digest|commit|uuid|guid|integrity|version|revision|etag|xxxx|your")
TEST_PATH = re.compile(r"(?i)test|mock|fixture|example|sample|doc|readme|lock|vendor|node_modules")
CONFIG_PATH = re.compile(r"(?i)\.env|config|settings|credential|secret|\.ya?ml|\.properties|\.ini|\.pem|deploy")
#: A run of key characters; '=' is part of one as its padding only.
CANDIDATE = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----|[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]|[ \t]+[\"']))?")
#: What follows a cue where a value is assigned: the rest of the name, a sign, and the value.
VALUE = re.compile(r"""[\w.-]{0,40}["'\]]{0,2}[ \t]{0,8}(?:=>|:=|={1,3}|:)[ \t]{0,8}(?i:(?:bearer|basic)[ \t]+)?(?:"(?P<double>[^"\n]+)"|'(?P<single>[^'\n]+)'|(?P<bare>(?:[^\s"'`<>,;&]|[,;&](?!\s|$|[\w.-]+[=:]))+))""")

#: The part of VALUE before a value.
HEAD = re.compile(r"""[\w.-]{0,40}["'\]]{0,2}[ \t]{0,8}(?:=>|:=|={1,3}|:)[ \t]{0,8}(?i:(?:bearer|basic)[ \t]+)?""")

FEATURES = ["length", "class_changes", "digit_share", "upper_share", "entropy", "repeats", "hex_only", "covered", "transitions", "test_path", "config_path", "cue_before", "doubt_near", "assigned", "quoted"]


class Lexicon:
    """Dictionary words, and how often a letter follows another one in them."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = frozenset(words)
        self.least, self.most = min(map(len, self.words), default=1), max(map(len, self.words), default=0)
        pairs = np.full((26, 26), 0.5)
        for w in sorted(self.words):
            codes = [ord(c) - 97 for c in w if "a" <= c <= "z"]
            for a, b in zip(codes, codes[1:], strict=False):
                pairs[a, b] += 1
        self.pairs = np.log2(pairs / pairs.sum(axis=1, keepdims=True))

    def covered(self, x: str) -> float:
        """The share of x, in lower case, that words cover from left to right, the longest first."""
        at, n, found = 0, len(x), 0
        while at < n:
            size = next((k for k in range(min(self.most, n - at), self.least - 1, -1) if x[at : at + k] in self.words), 0)
            found += size
            at += size or 1
        return found / n if n else 0.0

    def transitions(self, x: str) -> float:
        """The mean logarithm of the chances of a letter behind another one; without a pair of
        letters that of a random letter."""
        codes = [ord(c) - 97 if "a" <= c <= "z" else -1 for c in x]
        logs = [self.pairs[a, b] for a, b in zip(codes, codes[1:], strict=False) if a >= 0 and b >= 0]
        return float(np.mean(logs)) if logs else -float(np.log2(26))


#: The words above by themselves.
SMALL = Lexicon(WORDS)


@lru_cache(maxsize=4)
def lexicon(path: str, least: int = 4) -> Lexicon:
    """The whole words of ``least`` letters or more in the vocabulary of a public tokenizer's file, and WORDS."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    whole = (w.removesuffix("</w>") for w in vocabulary if w.endswith("</w>"))
    return Lexicon([*WORDS, *(w for w in whole if len(w) >= least and w.isascii() and w.isalpha() and w.islower())])


@dataclass(frozen=True)
class Finding:
    text: str
    start: int
    end: int
    path: str
    label: int


def values(text: str) -> list[tuple[int, int]]:
    """Spans that are assigned to a name with a cue in it, of any length and any characters.

    A value inside another one is left out where that is bare or has no spaces.  A bare value that begins
    inside a bare one ends with it, so each run of characters is matched once, whatever its cues."""
    out, covered = set(), 0
    for m in CUES.finditer(text):
        head = HEAD.match(text, m.end())
        if not head or head.end() < covered or not (v := VALUE.match(text, m.end())):
            continue
        start, end = v.span(v.lastgroup)
        if v.lastgroup == "bare" or not any(c.isspace() for c in v[v.lastgroup]):
            covered = v.end()
        if v.lastgroup == "bare":
            end = start + len(v["bare"].rstrip(".:)]}"))
        if end > start:
            out.add((start, end))
    return sorted(out)


def _candidates(text: str) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """Spans that look like secrets, and other runs of key characters outside of them."""
    assigned = values(text)
    whole = [(a, b) for a, b in assigned if not any(c.isspace() for c in text[a:b])]
    outer, at = [], 0
    for a, b in whole:
        if outer and outer[-1][0] == a:
            outer.pop()
        if not outer or b > outer[-1][1]:
            outer.append((a, b))
    out, other = set(assigned), set()
    for m in CANDIDATE.finditer(text):
        x = m[0]
        while at < len(outer) and outer[at][1] < m.end():
            at += 1
        if at == len(outer) or outer[at][0] > m.start():
            sure = x[0] == "-" and x.startswith("-----BEGIN") or any(c.isdigit() for c in x) and any(c.isalpha() for c in x)
            (out if sure else other).add(m.span())
    return out, other - out


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that may be secrets, in order: 16 or more key characters with a digit and a letter, a
    key's header, and the values beside a cue and an assignment.  Such a value stands for the runs
    inside it, unless it has spaces."""
    return sorted(_candidates(text)[0])


def every_candidate(text: str) -> list[tuple[int, int]]:
    """``candidates`` and all other runs of 16 or more key characters: numbers, words, rules."""
    return sorted(set.union(*_candidates(text)))


def features(text: str, start: int, end: int, path: str, words: Lexicon = SMALL) -> list[float]:
    x, n = text[start:end], end - start
    low = x.lower()
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in x]
    shares = [k / n for k in Counter(x).values()]
    before, after = text[max(0, start - 40) : start], text[end : end + 24]
    return [
        float(n), sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / n, kind.count("d") / n, kind.count("u") / n, -sum(s * float(np.log2(s)) for s in shares),
        sum(a == b for a, b in zip(x, x[1:], strict=False)) / n, float(all(c in string.hexdigits for c in x)), words.covered(low), words.transitions(low),
        float(bool(TEST_PATH.search(path))), float(bool(CONFIG_PATH.search(path))), float(bool(CUES.search(before)) or x.startswith("-----BEGIN")), float(bool(DOUBTS.search(before + x + after))),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in "\"'" and before[-1:] == after[:1] and before != ""),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), bound, left and right child, share of class 1."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, bound, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            while (feature[at] >= 0).any():
                inner = feature[at] >= 0
                low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= bound[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += share[at]
        return total / max(1, len(self.trees))


def _best_split(x: np.ndarray, y: np.ndarray, chosen: np.ndarray) -> tuple[int, float] | None:
    n, best = len(y), (1e-9, None)
    here = y.mean() * (1 - y.mean())
    for f in chosen.tolist():
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[:-1] < v[1:])
        if not len(at):
            continue
        k, a = at + 1, t[at] / (at + 1)
        b = (t[-1] - t[at]) / (n - k)
        gain = here - (k * a * (1 - a) + (n - k) * b * (1 - b)) / n
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (float(gain[i]), (f, float((v[at[i]] + v[at[i] + 1]) / 2)))
    return best[1]


def train_forest(findings: list[Finding], trees: int = 40, depth: int = 10, seed: int = 11, words: Lexicon = SMALL) -> Forest:
    """Trees over bootstrap samples, with a random root of the features tried at each split."""
    x = np.array([features(f.text, f.start, f.end, f.path, words) for f in findings], float).reshape(-1, len(FEATURES))
    y = np.array([f.label for f in findings], float)
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees if len(y) else 0):
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int, nodes=nodes) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
            if level < depth and len(rows) >= 4 and 0 < y[rows].mean() < 1:
                chosen = rng.permutation(x.shape[1])[: max(2, int(x.shape[1] ** 0.5) + 1)]
                if split := _best_split(x[rows], y[rows], chosen):
                    low = x[rows, split[0]] <= split[1]
                    nodes[at][:2] = split
                    nodes[at][2] = grow(rows[low], level + 1)
                    nodes[at][3] = grow(rows[~low], level + 1)
            return at

        grow(rng.integers(0, len(y), len(y)), 0)
        a = np.array(nodes)
        out.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return Forest(out)


def made_findings(n: int = 3000, seed: int = 3) -> list[Finding]:
    """Labelled findings by a rule: keys in assignments, and the digests, identifiers, numbers,
    addresses and placeholders that look like them."""
    rng = random.Random(seed)
    prose = lambda k: " ".join("".join(rng.choice(["the", "an", "er", "tion", "in", "de", "ou", "es", "que"]) for _ in range(rng.randint(1, 3))) for _ in range(k))
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    base64 = string.ascii_letters + string.digits
    out = []
    for i in range(n):
        label = int(i % 2 == 0)
        if label:
            key = rng.choice([
                lambda: pick("0123456789abcdef", rng.choice([32, 40, 64])), lambda: pick(base64 + "+/", rng.choice([32, 40, 44, 64])), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
                lambda: "ghp_" + pick(base64, 36), lambda: "sk_live_" + pick(base64, 24), lambda: pick(base64 + "-_", rng.randint(20, 60)),
            ])()
            name = rng.choice(["token", "api_key", "secret", "password", "access_key", "client_secret", "auth_token", "Authorization: Bearer"])
            quote = rng.choice(['"', "'", '"', ""])
            head = f"{name}{rng.choice([' = ', '=', ': ', ':'])}{quote}" if not name.endswith("Bearer") else name + " "
            tail = quote if not name.endswith("Bearer") else ""
            path = rng.choice(["", "src1", "app/main.py", "config/settings.yml", ".env", "deploy/prod.ini"])
        else:
            key, head, path = rng.choice([
                lambda: (pick("0123456789abcdef", rng.choice([40, 64])), rng.choice(["commit ", "sha256:", "checksum = ", "integrity ", "etag: "]), rng.choice(["", "src2", "package-lock.json"])),
                lambda: ("-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), rng.choice(["uuid ", "id=", "guid: "]), ""),
                lambda: (prose(3).replace(" ", rng.choice("-_/")) + str(rng.randint(1, 999)), rng.choice(["see ", "/", "file ", "class "]), rng.choice(["", "docs/a.md", "src3"])),
                lambda: (f"{rng.choice(WORDS)}{rng.randint(1, 99)}-{rng.choice(WORDS)}-{rng.choice(WORDS)}-version", rng.choice(["", "at ", "("]), "src4"),
                lambda: ("x" * 12 + "1234" + "x" * rng.randint(4, 20), rng.choice(["token = ", "api_key: ", "secret="]), "docs/readme.md"),
                lambda: ("your-api-key-" + rng.choice(["1234", "here0", "example1"]), "api_key = ", "example/config.yml"),
                lambda: (pick("0123456789abcdef", rng.choice([32, 40])), "token = ", "tests/fixtures/fake.json"),
                lambda: ("a" + pick(string.digits, rng.randint(16, 24)), rng.choice(["number ", "ref ", ""]), "src5"),
            ])()
            if len(key) < 16:
                key = key.ljust(16, "0")
            tail = rng.choice(["", '"', " "])
        left = prose(rng.randint(1, 5)) + " "
        text = left + head + key + tail + " " + prose(3)
        start = len(left + head)
        out.append(Finding(text, start, start + len(key), path, label))
    return out


def made_values(n: int = 1500, seed: int = 5) -> list[Finding]:
    """Labelled values beside a cue and an assignment: passwords with symbols and keys without
    digits, and the words, calls, types and placeholders that stand in their place."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: "".join(rng.choice(["the", "an", "er", "tion", "in", "de", "ou", "es", "que", "lo", "ra", "mi", "st"]) for _ in range(rng.randint(1, 4)))
    name = lambda: rng.choice(["token", "api_key", "API_KEY", "secret", "password", "DB_PASSWORD", "passwd", "access_key", "client_secret", "auth_token"])
    leet = str.maketrans({"o": "0", "e": "3", "i": "1", "s": "5", "a": "4"})
    symbols = "!@#$%^*&?+-_~"
    out = []
    for i in range(n):
        label = int(i % 2 == 0)
        if label:
            value = rng.choice([
                lambda: "".join(rng.sample(pick(string.ascii_lowercase, rng.randint(4, 8)) + pick(string.ascii_uppercase, rng.randint(1, 3)) + pick(string.digits, rng.randint(1, 4)) + pick(symbols, rng.randint(1, 3)), k=7)),
                lambda: word().capitalize().translate(leet) + rng.choice(symbols) + word().translate(leet) + pick(string.digits, rng.randint(1, 4)), lambda: word().capitalize() + pick(string.digits, rng.randint(2, 4)) + pick(symbols, rng.randint(1, 2)),
                lambda: pick(string.ascii_letters + string.digits + symbols, rng.randint(8, 32)), lambda: pick(string.ascii_letters + string.digits, rng.randint(8, 15)), lambda: pick(string.ascii_letters, rng.randint(16, 48)),
            ])()
            quote, path = rng.choice(['"', "'", '"', ""]), rng.choice(["", "src1", "app/main.py", "config/settings.yml", ".env"])
        else:
            value, quoted = rng.choice([
                lambda: (word(), rng.random() < 0.5), lambda: (" ".join(word() for _ in range(rng.randint(2, 8))), True), lambda: (rng.choice(["true", "false", "null", "None", "string", "str", "required", "optional", "yes", "no", "changeme"]), rng.random() < 0.4),
                lambda: (rng.choice(["get_", "self.", "config.", "os.environ.", "req.", "process.env."]) + word() + rng.choice(["", "()", "_" + word(), "." + word()]), False), lambda: (rng.choice(["${", "{{", "$", "%", "<"]) + "_".join([word(), *rng.choices(["key", "token", word()], k=rng.randint(0, 2))]).upper() + rng.choice(["}", "}}", "", "%", ">"]), True),
                lambda: (rng.choice(["/", "./", "https://", ""]) + word() + "/" + word(), rng.random() < 0.5), lambda: (pick(string.digits, rng.randint(1, 4)), False), lambda: (rng.choice(["your-", "example-", "dummy-", "fake_"]) + word(), True), lambda: (rng.choice("*x.") * rng.randint(3, 12), True),
                lambda: (word() + rng.choice("-_") + word(), rng.random() < 0.5),
            ])()
            quote, path = rng.choice("\"'") if quoted else "", rng.choice(["", "src2", "docs/a.md", "app/main.py", "config/settings.yml"])
        left = " ".join(word() for _ in range(rng.randint(0, 5))) + rng.choice([" ", "\n"])
        if not label and rng.random() < 0.1:  # a name that is assigned to
            key = "_".join([word(), rng.choice(["token", "key", "secret", "auth"]), word(), str(rng.randint(1, 99))]).ljust(16, "0")
            key = key.upper() if rng.random() < 0.7 else key
            out.append(Finding(f"{left}{key}={word()}", len(left), len(left) + len(key), path, label))
            continue
        head = name() + rng.choice([" = ", "=", ": ", ":"]) + quote
        start = len(left + head)
        out.append(Finding(left + head + value + quote + rng.choice([" ", "\n"]) + word(), start, start + len(value), path, label))
    return out


def made_runs(n: int = 1500, seed: int = 8) -> list[Finding]:
    """Labelled runs in prose: numbers, long words and rules, now and then beside a cue, none of them
    a secret, and keys of letters or digits alone where a value is assigned."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    syllable = ["the", "an", "er", "tion", "in", "de", "ou", "es", "que", "lo", "ra", "mi", "st", "keit", "sch", "eau", "ment", "ly", "ing", "hat", "on", "re", "at"]
    word = lambda k: "".join(rng.choice(syllable) for _ in range(k))
    out = []
    for i in range(n):
        label = int(i % 6 == 0)
        if label:
            key = rng.choice([lambda: pick(string.ascii_letters, rng.randint(20, 48)), lambda: pick(string.digits, rng.randint(20, 40)), lambda: pick(string.ascii_lowercase, rng.randint(24, 40))])()
            quote = rng.choice(['"', "'", ""])
            head, tail = rng.choice(["token", "api_key", "secret", "password", "access_key"]) + rng.choice([" = ", "=", ": "]) + quote, quote
        else:
            key = rng.choice([
                lambda: pick(string.digits, rng.randint(16, 24)), lambda: word(rng.randint(5, 9)).ljust(16, "n"), lambda: word(rng.randint(5, 9)).capitalize().ljust(16, "e"),
                lambda: rng.choice("-_=+/") * rng.randint(16, 60), lambda: "-".join(word(rng.randint(1, 3)) for _ in range(rng.randint(3, 6))).ljust(16, "s"), lambda: "/".join(word(rng.randint(1, 3)) for _ in range(rng.randint(3, 6))).ljust(16, "s"),
            ])()
            head, tail = rng.choice(["", "", "", "", "(", "no. ", "token ", '"', "the key "]), rng.choice(["", "", ".", ",", ")"])
        left = " ".join(word(rng.randint(1, 3)) for _ in range(rng.randint(0, 5))) + rng.choice([" ", "\n"])
        start = len(left + head)
        path = rng.choice(["", "src1", "docs/a.md", "app/main.py", "config/settings.yml"])
        out.append(Finding(left + head + key + tail + rng.choice([" ", "\n"]) + word(2), start, start + len(key), path, label))
    return out


@lru_cache(maxsize=4)
def made_forest(words: Lexicon = SMALL) -> Forest:
    """The forest of the findings made by a rule, trained once for each dictionary."""
    return train_forest(made_findings() + made_values() + made_runs(), words=words)


def scan(docs: DataFrame, findings: list[Finding] | None = None, threshold: float = 0.5, words: Lexicon = SMALL) -> DataFrame:
    """(doc_id, start, end, secret, score, is_secret), a row for each candidate of docs(doc_id, text,
    source, ...): offsets in code points, score the forest's share of class 1.

    ``source`` is taken as the path, null as ''.  ``words`` is the dictionary.  Without candidates a row gives none: so does a
    null or empty text.  Repeated rows repeat their findings; a null doc_id stays null.  An empty
    table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    forest = made_forest(words) if findings is None else train_forest(findings, words=words)
    names = ["doc_id", "start", "end", "secret", "score", "is_secret"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = [], []
            for doc, text, path in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text = text.as_py()
                for start, end in every_candidate(text):
                    rows.append((doc, start, end, text[start:end]))
                    x.append(features(text, start, end, path, words))
            p = forest.predict(np.array(x, float).reshape(-1, len(FEATURES)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), pa.array(p), pa.array(p >= threshold)], names)

    docs = parts(docs, "doc_id", "text", "source")
    path = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"), path.alias("path"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, secret string, score double, is_secret boolean")
