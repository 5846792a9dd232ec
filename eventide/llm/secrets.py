"""Guess cost of credential values, by dynamic programming over segments."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words by how early a guesser tries them.
COMMON = (
    "password 123456 qwerty letmein admin welcome secret changeme default root test guest example login master token dummy sample "
    "placeholder hello monkey dragon football baseball sunshine princess iloveyou trustno1 superman batman shadow michael ashley "
    "love user username pass passwd passphrase access account api key private public server client database service system network "
    "your my the none null true false value string here insert replace todo xxx foo bar baz abc summer winter spring autumn monday "
    "friday january february march april june july august september october november december company office home house family friend "
    "computer internet google apple windows linux ubuntu oracle mysql postgres redis mongo docker jenkins github gitlab amazon azure "
    "cloud prod production staging development dev debug demo temp temporary new old first last one two three four five six seven "
    "eight nine ten red blue green yellow black white orange purple silver gold star moon sun sky water fire earth wind light dark "
    "happy lucky money freedom magic power super ultra mega alpha beta gamma delta omega tiger eagle lion wolf bear horse dog cat "
    "welcome1 monkey1 starwars whatever freedom ninja mustang access14 jordan harley ranger hunter buster soccer hockey killer george charlie andrew "
    "thomas robert daniel jessica jennifer michelle nicole hannah amanda joshua matthew anthony william pepper ginger cookie cheese chocolate banana orange "
    "summer2 flower diamond silver golden matrix phoenix thunder snoopy tigger yankees chelsea arsenal liverpool barcelona samsung nokia toyota ferrari "
    "the and for you that with this have from they will would there their what about which when make can like time just know take people into year good some "
    "could them see other than then now look only come its over think also back after use how our work first well even want because any these give day most us "
    "correct battery staple purple passwort geheim motdepasse contrasena clave bonjour hallo hola soleil amour amor"
).split()
RANKS = {w: k + 1 for k, w in reversed(list(enumerate(COMMON)))}
#: Lengths of words that are learned from a corpus.
SHORTEST, LONGEST = 3, 24
#: How many words are learned.
LEARNED = 50_000
#: Parts of which each key word has one, so that the JVM needn't look closer at texts without any.
PARTS = ("pass", "pwd", "secret", "token", "key", "credential")
#: Words on each side of a word with such a part that aren't learned, as a secret may stand there.
NEAR = 32
LEET = str.maketrans("4@83601!|57$+", "aabegoiilstst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:])}
_NEXT |= {b + a for a, b in _NEXT}
SHIFT = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
#: Bits to say that a new segment begins and of which kind it is.
SEGMENT_BITS = 2.0
#: The longest unit whose repeats are looked for; repeats of longer ones cost what their parts do.
LONGEST_UNIT = 64
_DATES = [re.compile(p) for p in (
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d",
    r"(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\1(?:19|20)\d\d", r"(?:19|20)\d\d",
)]
_KEY = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_-]?key)?|token|api[_-]?key|access[_-]?key|auth[_-]?token|client[_-]?secret|credential|private[_-]?key)"
#: White space, and what identifiers are made of, in both pattern languages.
_BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_IN_NAME = r"[A-Za-z0-9_.\-]"
_SIGN = rf"[\"']?{_BLANK}*+(?:=>|:=|[:=])"
#: A key word within a name: "pass" not as the end of another English word; behind it plural, number, separator or a capital.
_WITHIN = rf"(?i:(?<!com)(?<!by)(?<!tres)(?<!sur)(?<!over)(?<!under)({_KEY}))(?:(?i:s))?(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
#: A name that holds a key word of a credential, then a sign of assignment. A name is looked at only if a sign follows, so that time is in proportion to the text.
CONTEXT = re.compile(rf"(?<!{_IN_NAME})(?={_IN_NAME}++{_SIGN})(?={_IN_NAME}*?{_WITHIN})({_IN_NAME}++){_SIGN}{_BLANK}*+")
#: A key word that touches the sign counts before others in its name.
_LAST = re.compile(rf"(?i)(?<![a-z0-9])({_KEY})\Z")
#: The value: quoted, up to the end of the line if the quote stays open, or up to white space.
VALUE = re.compile(r"\"([^\"\r\n]+)(\"?)|'([^'\r\n]+)('?)|([^\s\"'`<>]+)")
#: What a text must hold for CONTEXT to match, in the pattern language of the JVM.
HINT = rf"(?i)(?<!{_IN_NAME})(?={_IN_NAME}++{_SIGN}){_IN_NAME}*?(pass|pwd|secret|token|key|credential)"
#: Bare "tokens" with a number is a count.
_COUNT = re.compile(r"\d{1,12}")


def brute_bits(s: str) -> float:
    """Bits of one character for each of its class: digits, separators, lower, upper, signs, others."""
    return sum(math.log2(10 if c in "0123456789" else 4 if c in "_-. " else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if " " <= c <= "~" else 100) for c in s)


def word_bits(s: str, ranks: dict[str, int] = RANKS) -> float | None:
    """Bits of a common word with capitals and look-alike signs; None of another."""
    low = s.lower()
    rank, leet = ranks.get(low), 0.0
    if rank is None:
        plain = low.translate(LEET)
        rank = ranks.get(plain)
        if rank is None:
            return None
        leet = 1.0 + sum(a != b for a, b in zip(low, plain))
    capital = 0.0 if s == low else 1.0 if s == low.capitalize() or s == s.upper() else 1.0 + len(s)
    return math.log2(rank) + 1 + leet + capital


def segments(s: str, ranks: dict[str, int] = RANKS) -> Iterator[tuple[int, int, str, float | None]]:
    """All segments that cost can be saved with: (from, to, kind, bits); a repeat's bits come of its unit, so they are None.

    Words of the list; dates; the longest repeat of each unit of up to ``LONGEST_UNIT`` characters, twice or more and of
    3 characters at least; the longest keyboard walk of 4 keys or more from each place, and the longest run of 4 or
    more letters or digits in the order of the alphabet or against it.
    """
    n, low = len(s), s.lower()
    keys = s.translate(SHIFT).lower()
    walk = [1] * (n + 1)
    for i in range(n - 2, -1, -1):
        walk[i] = walk[i + 1] + 1 if keys[i : i + 2] in _NEXT else 1
    steps = [ord(b) - ord(a) if a.isalnum() and b.isalnum() else 0 for a, b in zip(low, low[1:])]
    ordered = [1] * (n + 1)
    for i in range(n - 2, -1, -1):
        if abs(steps[i]) == 1:
            ordered[i] = ordered[i + 1] + 1 if i + 1 < n - 1 and steps[i + 1] == steps[i] else 2
    runs: dict[int, list[int]] = {}
    for p in range(1, min(LONGEST_UNIT, n // 2) + 1):
        r = [0] * (n + 1)
        for i in range(n - p - 1, -1, -1):
            r[i] = r[i + 1] + 1 if low[i] == low[i + p] else 0
        runs[p] = r
    for i in range(n):
        for j in range(i + 2, min(n, i + LONGEST) + 1):
            bits = word_bits(s[i:j], ranks)
            if bits is not None:
                yield i, j, "word", bits
        if s[i].isdigit():
            for k, d in enumerate(_DATES):
                m = d.match(s, i)
                if m:
                    yield i, m.end(), "date", math.log2(130 if k == 3 else 130 * 366) + (2.0 if m.lastindex and m[1] else 1.0)
        for p, r in runs.items():
            times = r[i] // p + 1
            if times >= 2 and p * times >= 3:
                yield i, i + p * times, f"repeat{p}", None
        if walk[i] >= 4:
            w = s[i : i + walk[i]]
            turns = sum(keys[i + k] == keys[i + k + 2] for k in range(len(w) - 2))
            yield i, i + len(w), "walk", math.log2(47) + math.log2(len(w)) + 1 + 2 * turns + (0.0 if w == w.lower() else 2.0)


        if ordered[i] >= 4:
            w = s[i : i + ordered[i]]
            yield i, i + len(w), "walk", math.log2(36) + math.log2(len(w)) + 2 + (0.0 if w == w.lower() else 2.0)


def guess_bits(s: str, ranks: dict[str, int] = RANKS) -> tuple[float, list[tuple[str, str]]]:
    """Log2 of the guesses that the cheapest segmentation of ``s`` takes, and that segmentation.

    A segment costs ``SEGMENT_BITS`` plus the bits of its kind; brute-force spans, of any length, cost those of
    their characters. A repeat costs its unit, by brute force or as a word, and the number of times.
    """
    n = len(s)
    by_end: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
    for i, j, kind, bits in segments(s, ranks):
        if bits is None:
            unit = s[i : i + int(kind[6:])]
            bits = min(brute_bits(unit), word_bits(unit, ranks) or math.inf) + math.log2((j - i) / len(unit)) + 1
            kind = "repeat"
        by_end[j].append((i, kind, bits))
    inf = math.inf
    best, brute = [0.0] + [inf] * n, [inf] * (n + 1)  # brute: the last segment is a brute-force span
    how: list[tuple[int, str]] = [(0, "")] * (n + 1)
    start = [0] * (n + 1)
    for j in range(1, n + 1):
        step = brute_bits(s[j - 1])
        # the span goes on, or begins with this character
        go, new = brute[j - 1] + step, best[j - 1] + SEGMENT_BITS + step
        brute[j], start[j] = (go, start[j - 1]) if go <= new else (new, j - 1)
        best[j], how[j] = brute[j], (start[j], "brute")
        for i, kind, bits in by_end[j]:
            cost = best[i] + SEGMENT_BITS + bits
            if cost < best[j]:
                best[j], how[j] = cost, (i, kind)
    out, j = [], n
    while j:
        i, kind = how[j]
        out.append((s[i:j], kind))
        j = i
    return best[n], out[::-1]


def _may_hold(text: F.Column) -> F.Column:
    low = F.lower(text)
    out = low.contains(PARTS[0])
    for x in PARTS[1:]:
        out = out | low.contains(x)
    return out


def far_words(text: str) -> list[str]:
    """The words of a text that may be learned and stand more than ``NEAR`` words from any word with a part of a key word."""
    words = re.findall(r"\w+", text.lower())
    near = bytearray(len(words))
    for i, w in enumerate(words):
        if any(x in w for x in PARTS):
            at = max(0, i - NEAR)
            near[at : i + NEAR + 1] = b"\1" * (min(len(words), i + NEAR + 1) - at)
    return [w for w, skip in zip(words, near) if not skip and SHORTEST <= len(w) <= LONGEST and w.isalpha()]


def learned_ranks(docs: DataFrame, most: int = LEARNED, text: str = "text") -> dict[str, int]:
    """The list's words and, behind them, the ``most`` commonest words of the corpus by rank.

    Words are whole runs of letters, of 3 to 24 of them, seen three times or more. They are counted over all texts, but for the ``NEAR`` words on each
    side of a word with a part of a key word, so that a secret, however many copies it has, isn't learned from where it is given away.
    """
    plain = docs.where(~_may_hold(F.col(text))).select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+")).alias("w"))
    plain = plain.where(F.col("w").rlike(rf"^\p{{L}}{{{SHORTEST},{LONGEST}}}$")).select("w", F.lit(1).cast("long").alias("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter(w for t in batch.column(0) for w in far_words(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["w", "n"])

    rest = docs.select(F.col(text).alias("t")).where(_may_hold(F.col("t"))).mapInArrow(count, "w string, n long")
    words = plain.unionByName(rest).groupBy("w").agg(F.sum("n").alias("n")).where("n >= 3")
    # a limit at the root would send the driver ``most`` words of every partition; below an exchange one task merges them
    found = words.orderBy(F.desc("n"), "w").limit(most).repartition(1).collect() if most else []
    out = dict(RANKS)
    for r in sorted(found, key=lambda r: (-r["n"], r["w"])):
        out.setdefault(r["w"], len(out) + 1)
    return out


def scan_secrets(docs: DataFrame, least_bits: float = 48.0, text: str = "text", doc_id: str = "doc_id", learned: int = LEARNED) -> DataFrame:
    """Values in credential contexts: (doc_id, key, position, length, guess_bits, segments, is_secret).

    A context is a name with a key word (password, token, api_key ...), an assignment sign and a value, anywhere in
    the text, with any white space around the sign. The name may have more before the key word (dbPassword, aws_access_key) and
    behind it (api_key_v2, aws_access_key_id, passwords, accessTokenValue); "pass" isn't a key word inside of compass and the like, and
    nothing is where lower-case letters go on (tokenizer, passenger). Bare "tokens" with a number of up to 12 digits is a count and isn't reported. A value is
    quoted, up to the end of its line if the quote isn't closed, or up to white space; contexts inside a value are reported
    too. The value's guess cost is that of its cheapest segmentation into
    common words, dates, repeats, keyboard walks and brute-force spans; ``is_secret`` says that it takes
    2 ** ``least_bits`` guesses or more, so that placeholders aren't reported as secrets. The value itself
    isn't returned, but where it stands (characters from 0). Closing punctuation isn't part of an unquoted value.

    Words cost by their rank: first those of a list of common passwords, then the ``learned`` commonest words of the
    corpus itself, counted over all its texts but for words near key words (``learned_ranks``); they are broadcast.

    The JVM picks the texts that hold a context; those alone go to Python. Null or empty text: no rows. Null
    ids are kept. Repeated rows and values are reported each. A value of any length is scored in full, in time
    proportional to it, for each context whose value it is in. Empty table: empty result. Other columns are ignored.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(learned_ranks(docs, learned, text))
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("position", pa.int64()), ("length", pa.int64()), ("guess_bits", pa.float64()), ("segments", pa.string()), ("is_secret", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist()):
                for key, at, value in credential_values(t):
                    bits, parts = guess_bits(value, ranks.value)
                    rows.append((d, key, at, len(value), round(bits, 6), " ".join(k for _, k in parts), bits >= least_bits))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    mine = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where(_may_hold(F.col("t")) & F.col("t").rlike(HINT))
    return mine.mapInArrow(run, "doc_id long, key string, position long, length long, guess_bits double, segments string, is_secret boolean")


def credential_values(text: str) -> Iterator[tuple[str, int, str]]:
    """(key, position, value) of each credential context; a value may hold further ones."""
    for m in CONTEXT.finditer(text):
        v = VALUE.match(text, m.end())
        if v is None:
            continue
        k = v.lastindex if v.lastindex == 5 else v.lastindex - 1
        value = v[k]
        if k == 5:
            value = value.rstrip(".,;:!?)]}")
        elif not v[k + 1]:
            value = value.rstrip()
        last = _LAST.search(m[2])
        key = (last or m)[1].lower()
        if not value or m[2].lower() == "tokens" and _COUNT.fullmatch(value):
            continue
        yield key, v.start(k), value
