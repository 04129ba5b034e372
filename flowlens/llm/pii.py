"""Personal data: exact base patterns plus the spans that a linear-chain CRF over word-shape features adds.

The base patterns are the contract: their spans always stay. The CRF is trained from a small labelled table (``labelled_table``) of
sentences with emails, addresses, cards, phones, identity numbers and secrets (keys, tokens, passwords) in many written forms, beside
numbers and names that are none of these; it is decoded by Viterbi in numpy batches, over tokens parted by white space, signs of
assignment, quotes and brackets, so that a value glued to its name has a token of its own. A run of tokens of one kind
is divided into its values (``_values``), each a span, added where no base span overlaps.

Defined cases: a null text counts as empty and has no spans (``redact_column`` leaves it null); a very long text is matched whole by the
patterns and decoded in blocks cut at white space; equal spans occur once; of tags that score alike the first of ``KINDS`` wins; repeated
rows each get their own, equal result; an empty table gives no rows. Offsets are code points, end exclusive. Only the named text column is
read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.llm.blocks import Block, as_texts, blocks, char_tables, mix, run_hashes
from flowlens.llm.common import small_batches
from flowlens.llm.crf import Crf, train

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "secret")
BITS = 14

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost match starts where the run of local characters before an @ starts, or where the last match ended."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """In a maximal run of dotted numbers the leftmost matches are its successive groups of four."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by start, then kind."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT(text):
        spans += [(a, 1, b) for a, b in _addresses(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


_DIGIT = re.compile("[0-9]").search
_SPELLED_EMAIL = re.compile(r"(?i)[\w.-]+(?: dot [\w-]+)* at [\w-]+(?: dot [\w-]+)+|[\w.-]+ ?[(\[]at[)\]] ?[\w-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[\w-]+)+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+")


#: What parts tokens beside white space: signs of assignment, quotes, brackets and marks of lists, so that a glued value has its own token.
SEPARATORS = "=:,;|\"'`()[]{}<>"


def _separators() -> np.ndarray:
    table = np.zeros(128, bool)
    table[[ord(c) for c in SEPARATORS]] = True
    return table


def _within_address(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places hold a colon of an address: hex digits, at most four, before it, and one or another colon behind it, as a time of day has, too."""
    hexes = ((codes >= 48) & (codes <= 57)) | ((codes >= 65) & (codes <= 70)) | ((codes >= 97) & (codes <= 102))
    colon = codes == 58
    edge = np.maximum.accumulate(np.where(hexes, -1, np.arange(len(codes))))  # the last place that is no hex digit
    length = np.where(at > 0, at - 1 - edge[at - 1], 0)
    led = (at > 0) & (((length >= 1) & (length <= 4) & ((edge[at - 1] < 0) | ~char_tables()["alnum"][codes[edge[at - 1]]])) | colon[at - 1])
    behind = codes[np.minimum(at + 1, len(codes) - 1)]
    return colon[at] & led & (hexes[np.minimum(at + 1, len(codes) - 1)] | (behind == 58))


def token_features(block: Block) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of tokens: shape, length, word and the marks around them, of the token and its neighbours. Also starts, ends, pieces.

    The shape maps letters to x or X and digits to 9 and collapses repeats in tokens without a digit or @; others keep their lengths.
    """
    tables = char_tables()
    codes = block.codes
    parts = _separators()[np.minimum(codes, 127)] & (codes < 128)
    parts[parts] = ~_within_address(codes, np.flatnonzero(parts))
    inside = ~(tables["space"][codes] | parts)
    inside[block.at + block.lengths] = False
    starts, ends, piece = block.runs(inside)
    kind = np.where(tables["alpha"][codes], np.where(tables["upper"][codes], 1, 2), np.where(tables["digit"][codes], 3, np.where(codes < 128, codes, 4))).astype(np.uint32)
    named = (kind == 1) | (kind == 2) | (kind == 3)
    marked = np.concatenate([[0], np.cumsum((kind == 3) | (codes == 64))])
    telling = marked[ends] > marked[starts]
    keep = np.ones(len(codes), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    shape = run_hashes(kind[keep], kept[starts], kept[ends])
    if telling.any():
        digits = np.where(kind == 3, 3, np.where((kind == 1) | (kind == 2), 2, kind))
        collapse = np.ones(len(codes), bool)
        collapse[1:] = (digits[1:] != digits[:-1]) | (digits[1:] == 3)
        collapse[starts] = True
        kept = np.concatenate([[0], np.cumsum(collapse)])
        shape[telling] = run_hashes(digits[collapse], kept[starts[telling]], kept[ends[telling]]) + np.uint64(1)
    # The word without a mark at its end, and its last part: "client_secret" ends as "secret" does.
    stop = ends - (~named[ends - 1] & (ends - starts > 1))
    word = run_hashes(block.lower, starts, stop)
    enclosed = (starts > 0) & np.isin(codes[starts - 1], (40, 91)) & np.isin(codes[np.minimum(ends, len(codes) - 1)], (41, 93))
    word = np.where(enclosed, word + np.uint64(1), word)  # "(at)" is another word than "at"
    mark = np.maximum.accumulate(np.where(named, -1, np.arange(len(codes))))
    part = run_hashes(block.lower, np.minimum(np.maximum(starts, mark[stop - 1] + 1), stop), stop)
    first, last = np.diff(piece, prepend=-1) != 0, np.diff(piece, append=-1) != 0

    def near(h: np.ndarray, step: int) -> np.ndarray:
        out = np.roll(h, step)
        out[first if step > 0 else last] = np.uint64(7)
        return out

    size = np.minimum(ends - starts, 24).astype(np.uint64)
    # How often digits and letters, or lower and upper case, take turns in a token, by its length: keys and tokens do so, words and numbers do not.
    turns = np.concatenate([[0, 0], np.cumsum((kind[1:] != kind[:-1]) & (kind[1:] <= 3) & (kind[:-1] <= 3) & (kind[1:] > 0) & (kind[:-1] > 0))])
    mixed = np.minimum(turns[ends] - turns[np.minimum(starts + 1, ends)], 6).astype(np.uint64) + np.uint64(8) * np.minimum((ends - starts) // 6, 7).astype(np.uint64)
    around = np.where(tables["space"][codes], 32, np.minimum(codes, 255)).astype(np.uint64)
    before = np.where(starts > 0, around[starts - 1], 32).astype(np.uint64)
    before2 = np.where(starts > 1, around[starts - 2], 32).astype(np.uint64)
    after = around[np.minimum(ends, len(codes) - 1)]
    # Two words before: the name of an assigned value stands there.
    features = [
        shape, size + np.uint64(64) * telling, word, near(shape, 1), near(shape, -1), near(word, 1), near(word, -1), mixed, near(near(word, 1), 1), near(part, 1), before + np.uint64(256) * before2, after + np.uint64(256) * before,
    ]
    return [(mix(h + np.uint64(k << 58)) >> np.uint64(64 - BITS)).astype(np.int64) for k, h in enumerate(features)], starts, ends, piece


def labelled_table(rows: int = 3000, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The small labelled table: sentences with their (start, end, kind number) spans, written by rule from forms and contexts."""
    rng = np.random.default_rng(seed)
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda options: options[rng.integers(len(options))]
    hexes, letters = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    some = lambda options, n: "".join(options[i] for i in rng.integers(0, len(options), n))
    syllables = "an ber con de el fer gra hi in jo ka lo mi ne or pa que ri sa tion un ver wa xi yo za".split()
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))
    name = lambda: pick("ana ben carla david emma felix grace hugo ines jan".split())
    iban = lambda digits, gap: pick(["GB", "DE", "FR", "ES", "IT", "NL"]) + digit(2) + gap + gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    forms = (
        (lambda: f"{name()}.{word()}@{word()}.{pick(['com', 'org', 'net', 'example.com'])}", lambda: f"{digit(2)}@{word()}{digit(1)}.example.com", lambda: f"{name()} at {word()} dot com", lambda: f"{name()} dot {word()} at {word()} dot org", lambda: f"{name()}(at){word()}.com", lambda: f"{name()}[at]{word()}[dot]net", lambda: f"{word()} (at) {word()} (dot) {pick(['com', 'org', 'net'])}", lambda: f"{word()} [at] {word()} [dot] {pick(['com', 'org', 'net'])}", lambda: f"{word()} at {word()} dot {pick(['com', 'org', 'net'])}"),
        (lambda: ".".join(str(rng.integers(1, 256)) for _ in range(4)), lambda: ":".join(f"{rng.integers(4096, 65536):x}" for _ in range(8))),
        (lambda: digit(16), lambda: "-".join(digit(4) for _ in range(4)), lambda: " ".join(digit(4) for _ in range(4)), lambda: f"{digit(4)} {digit(6)} {digit(5)}", lambda: digit(13), lambda: f"{digit(4)} {digit(4)} {digit(4)} {digit(1)}"),
        (lambda: f"+{digit(1)} ({digit(3)}) {digit(3)}-{digit(4)}", lambda: f"({digit(3)}) {digit(3)}-{digit(4)}", lambda: f"{digit(3)}-{digit(3)}-{digit(4)}", lambda: f"{digit(3)}.{digit(3)}.{digit(4)}", lambda: f"+{digit(2)} {digit(3)} {digit(3)} {digit(4)}", lambda: f"00{digit(2)} {digit(2)} {digit(7)}", lambda: f"0{digit(3)} {digit(3)} {digit(3)}", lambda: f"+{digit(2)} {digit(2)} {digit(4)} {digit(4)}"),
        (lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", lambda: f"{pick(['GB', 'DE', 'FR', 'ES'])}{digit(2)} {digit(4)} {digit(4)} {digit(4)} {digit(4)}", lambda: f"{pick('ABCDEFGH')}{pick('ABCDEFGH')}{digit(6)}{pick('ABCD')}", lambda: iban(digit(int(rng.choice([16, 18, 20]))), " "), lambda: iban(digit(int(rng.choice([14, 18, 20, 21]))), " "), lambda: iban(digit(int(rng.choice([14, 16, 18, 20]))), ""), lambda: digit(9)),
        (lambda: f'"{some(hexes, 40)}"', lambda: f'"{some(hexes, 32)}"', lambda: some(hexes, 64), lambda: f"'{some(letters, 24)}'", lambda: some(letters, 40), lambda: f"AKIA{some(letters.upper(), 16)}", lambda: f"ghp_{some(letters, 36)}", lambda: f"sk-{some(letters, 32)}", lambda: f"eyJ{some(letters, 17)}.eyJ{some(letters, 30)}.{some(letters, 27)}", lambda: f"{word().capitalize()}{digit(3)}{pick('!#%')}{some(letters, 4)}", lambda: f"{some(letters[:26], 4)}{digit(3)}{pick('!#%$')}{some(letters[:26], 3)}", lambda: some(letters, int(rng.integers(20, 48))), lambda: some(letters, int(rng.integers(24, 40)))),
    )
    cues = (("email", "write to", "mail", "e-mail:", "reach", "", "", "contact"), ("address", "host", "from ip", "server", ""), ("card", "card number", "visa", "paid with", ""), ("call", "phone", "tel:", "mobile", "ring", "", "call me at", "reach us at", "at", ""), ("ssn", "ssn:", "SSN", "passport", "iban", "iban:", "account", "social security number", "id number"), ("token =", "token", "api_key =", "api key:", "secret =", "secret key", "password:", "password =", "key =", "access token:", "authorization: bearer", "auth ="))
    others = (lambda: f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", lambda: f"{rng.integers(1, 29)}/{rng.integers(1, 13)}/{rng.integers(1990, 2030)}", lambda: f"${digit(3)}.{digit(2)}", lambda: f"version {digit(1)}.{digit(1)}.{digit(1)}", lambda: digit(rng.integers(1, 9)), lambda: f"{digit(2)}:{digit(2)}", lambda: f"order {digit(10)}", lambda: f"{digit(2)}%", lambda: f"page {digit(3)}", lambda: f"at {word()}", lambda: f"{word()} dot {word()}", lambda: f"{digit(1)},{digit(3)},{digit(3)}", lambda: f"{word()}{pick(['###', '$$$', '%%%', '!!', ' |', '***', '&&&'])}", lambda: digit(20), lambda: f"@{word()}", lambda: word().upper(), lambda: f"commit {some(hexes, 40)}", lambda: f"sha256 {some(hexes, 64)}", lambda: f"token {word()}", lambda: f"key = {word()}", lambda: f"secret {word()}", lambda: f"{word()} = {digit(2)}", lambda: f"https://{word()}.example.org/{word()}/{some(letters, 12)}", lambda: f"{word()}{digit(2)}", lambda: f"{word()}={digit(rng.integers(1, 5))}", lambda: f"{word()}({word()}, {word()})", lambda: f'{{"{word()}": "{word()}", "n": {digit(3)}}}', lambda: f"{word()}: {word()}", lambda: f"({word()} at {word()})", lambda: f"{pick(['token', 'key', 'secret', 'password'])}={word()}", lambda: f"{pick(['password', 'token'])}: {word()}", lambda: f"isbn {digit(3)}-{digit(1)}-{digit(2)}-{digit(6)}-{digit(1)}", lambda: f"{digit(9)} {word()}", lambda: f"[{digit(2)}]", lambda: f"id={digit(5)}", lambda: f"id {digit(4)}", lambda: f"{word()}_{word()}={word()}_{word()}", lambda: f"{word()} #{digit(6)}", lambda: f"tracking {digit(12)}")
    # A value may be glued to its name, and a secret may stand in quotes or in a pair of a JSON object or a setting.
    names = ("email mail contact", "ip host server", "card visa number", "phone tel mobile", "ssn iban id", "token api_key secret key password access_token auth secret_key API_KEY passwd apikey private_key TOKEN")
    pairs = ("{n}={v}", "{n}:{v}", "{n}: {v}", "{n} = {v}", '{n}="{v}"', "{n}='{v}'", "{n}: '{v}'", '{{"{n}": "{v}"}}', '{{"{n}":"{v}"}}', '"{n}":"{v}",', '{{"user": "x", "{n}": "{v}", "n": 1}}', "({n}={v})", "?{n}={v}")
    table = []
    for _ in range(rows):
        text, spans = " ".join(word() for _ in range(rng.integers(0, 6))), []
        for _ in range(rng.integers(0, 3)):
            roll = rng.random()
            if roll < 0.2:
                kind = int(rng.choice(len(KINDS), p=[0.08, 0.05, 0.07, 0.1, 0.2, 0.5]))
                value = pick(forms[kind])().strip("\"'")
                made = pick(pairs).format(n=pick(names[kind].split()), v=value)
                lead = f"{text} ".lstrip()
                at = len(lead) + made.rindex(value)
                spans.append((at, at + len(value), kind))
                text = lead + made
            elif roll < 0.62:
                kind = int(rng.integers(len(KINDS)))
                lead = f"{text} {pick(cues[kind])}".strip()
                form, mark = pick(forms[kind]), pick([", ", " ", "; "])
                text = lead
                for k in range(int(rng.choice([1, 2, 3], p=[0.7, 0.2, 0.1]))):  # single values, and lists of them
                    value = form()
                    text = f"{text}{mark if k else ' '}{value}".strip()
                    spans.append((len(text) - len(value), len(text), kind))
                text += pick(["", "", ".", ","])
            else:
                text = f"{text} {pick(others)()}".strip()
            text = f"{text} {' '.join(word() for _ in range(rng.integers(1, 5)))}".strip()
        table.append((text.capitalize() if rng.random() < 0.3 and not spans else text, spans))
    return table


@lru_cache(maxsize=1)
def model() -> Crf:
    """The CRF trained on ``labelled_table``; label 0 is none, label k + 1 is ``KINDS[k]``."""
    table = labelled_table()
    features, labels, lengths = None, [], []
    for block in blocks([text for text, _ in table]):
        got, starts, ends, piece = token_features(block)
        features = got if features is None else [np.concatenate(x) for x in zip(features, got)]
        tags = np.zeros(len(starts), np.int64)
        for k, row in enumerate(block.rows):
            for a, b, kind in table[row][1]:
                tags[(piece == k) & (starts - block.at[k] < b) & (ends - block.at[k] > a)] = kind + 1
        labels.append(tags)
        count = np.bincount(piece, minlength=len(block.rows))
        lengths.append(count[count > 0])
    return train(features, np.concatenate(labels), np.concatenate(lengths), 1 << BITS, len(KINDS) + 1)


def _acceptable(kind: int, value: str) -> bool:
    """What a tagged run must hold at least to be taken for its kind."""
    digits = sum(c.isdigit() for c in value)
    if kind == 0:
        return bool(_SPELLED_EMAIL.fullmatch(value))
    if kind == 1:
        return value.count(".") == 3 or value.count(":") >= 2
    if kind == 2:
        return 13 <= digits <= 19 and luhn("".join(c for c in value if c.isdigit() and c.isascii()))
    if kind == 5:
        return len(value) >= 8 and 0 < digits < sum(c.isalnum() for c in value)
    return 7 <= digits <= 15 if kind == 3 else 6 <= digits <= 30


#: What stands between values of a list parts a run into atoms, of which a value takes some in a row.
_ATOM = re.compile(r"[^\s,;|]+")
_BETWEEN = re.compile(r"[,;|\r\n]")
_FORMS = {
    3: re.compile(r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"),
    4: re.compile(r"[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?(?![A-Z]{2}[0-9]{2})[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?"),
}
#: A secret in a tagged run, without the name it is assigned to and the quotes around it.
_SECRET = re.compile(r"""(?![A-Za-z_-]+[=:])[^\s"'=:,;<>()]{8,}""")
_AT = re.compile(r"@|(?i:at)(?![^\W_])")
_LED_BY_AT, _NAME_BEFORE = re.compile(r"(?i)at(?![^\W_])"), re.compile(r"[\w.-]+ ?[(\[]?$")
#: Digits below and beyond which no piece of a run is acceptable, and the most atoms of a piece; the run as a whole may have more.
_DIGITS = {2: (13, 19), 3: (7, 15), 4: (6, 30)}
_MOST_ATOMS = 40


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def _values(kind: int, text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The values in a tagged run, which may be a list: acceptable pieces that cover most of it, in as usual forms as can be.

    A piece of usual form costs 1, another one 2 for each atom and 3 for each mark of lists in it; of equal costs fewer pieces win.
    A run that is acceptable as a whole stays one value unless it falls into several.
    """
    a, b = _trimmed(text, a, b)
    run = text[a:b]
    if kind == 5:
        return [m.span() for m in _SECRET.finditer(text, a, b) if _acceptable(kind, m.group())]
    if (kind == 0 and not _AT.search(run)) or (kind == 1 and run.count(".") < 3 and run.count(":") < 2):
        return []
    whole = [(a, b)] if a < b and _acceptable(kind, run) else []
    atoms = [m.span() for m in _ATOM.finditer(text, a, b)]
    if len(atoms) < 2:
        return whole
    size = [sum(map(str.isalnum, text[i:j])) for i, j in atoms]
    digits = [sum(map(str.isdigit, text[i:j])) for i, j in atoms]
    least, most = _DIGITS.get(kind, (0, len(text)))
    if sum(digits) < least:
        return []
    if kind == 0:  # an e-mail has an @ or "at", which is counted as the digits of the other kinds are
        digits, least = [bool(_AT.search(text, i, j)) for i, j in atoms], 1
    # Up to each atom: what is covered, minus the cost, minus the number of pieces, and the last piece with the atom it begins at.
    best: list[tuple[int, int, int, int, tuple[int, int] | None]] = [(0, 0, 0, 0, None)]
    for j in range(len(atoms)):
        top, held, counted = (*best[j][:3], j, None), 0, 0
        for i in range(j, max(-1, j - _MOST_ATOMS), -1):
            held += size[i]
            counted += digits[i]
            if counted > most:
                break
            if counted < least or not size[i] or not size[j]:
                continue
            piece = _trimmed(text, atoms[i][0], atoms[j][1])
            value = text[piece[0] : piece[1]]
            if not _acceptable(kind, value):
                continue
            marks = len(_BETWEEN.findall(value))
            usual = not marks and (i == j or kind in (0, 2) or bool(kind in _FORMS and _FORMS[kind].fullmatch(value)))
            before = best[i]
            top = max(top, (before[0] + held, before[1] - (1 if usual else 2 * (j - i + 1) + 3 * marks), before[2] - 1, i, piece), key=lambda x: x[:3])
        best.append(top)
    pieces, at = [], len(atoms)
    while at:
        if best[at][4]:
            pieces.append(best[at][4])
        at = best[at][3]
    return pieces[::-1] if len(pieces) > 1 or not whole else whole


def crf_spans(crf: Crf, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind number, end) of the values in the tagged runs of each text, without the marks around them."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for block in blocks(texts):
        features, starts, ends, piece = token_features(block)
        if not len(starts):
            continue
        tags = crf.viterbi(crf.emissions(features), np.bincount(piece, minlength=len(block.rows)))
        hit = np.flatnonzero(tags)
        if not len(hit):
            continue
        fresh = np.ones(len(hit), bool)
        fresh[1:] = (np.diff(hit) > 1) | (tags[hit[1:]] != tags[hit[:-1]]) | (piece[hit[1:]] != piece[hit[:-1]])
        for group in np.split(hit, np.flatnonzero(fresh)[1:]):
            k, kind = piece[group[0]], int(tags[group[0]]) - 1
            shift = int(block.begin[k] - block.at[k])
            a, b = int(starts[group[0]]) + shift, int(ends[group[-1]]) + shift
            text = texts[block.rows[k]]
            if kind == 0 and _LED_BY_AT.match(text, a):  # the name before an "at" belongs to it
                before = _NAME_BEFORE.search(text, max(0, a - 80), a)
                a = before.start() if before else a
            if a and text[a - 1] == "(" and ")" in text[a:b]:  # a phone number's bracket is no part of its first token
                a -= 1
            found[block.rows[k]] += [(i, kind, j) for i, j in _values(kind, text, a, b)]
    return found


def find(crf: Crf, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans, and all spans, of each text."""
    out = []
    for text, tagged in zip(texts, crf_spans(crf, texts)):
        base = base_spans(text)
        added, k, reach = [], 0, 0
        for span in sorted(set(tagged)):  # both are in order of their starts, so one pass tells which touch
            while k < len(base) and base[k][0] < span[2]:
                reach = max(reach, base[k][2])
                k += 1
            if reach <= span[0]:
                added.append(span)
        out.append((base, sorted([*base, *added]) if added else base))
    return out


def spans_column(session, text: str | Column = "text") -> Column:
    """struct<base, spans array<struct<start, end, kind>>> for a text column."""
    shared = small_batches(session).sparkContext.broadcast(model())
    one = "array<struct<start:long,end:long,kind:string>>"

    @F.pandas_udf(f"base {one}, spans {one}")
    def compute(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rows = lambda spans: [{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in spans]
        for part in parts:
            got = find(shared.value, as_texts(part))
            yield pd.DataFrame({"base": [rows(b) for b, _ in got], "spans": [rows(s) for _, s in got]})

    return compute(text)


def redact_column(session, text: str | Column = "text") -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one; null stays null."""
    shared = small_batches(session).sparkContext.broadcast(model())

    @F.pandas_udf("string")
    def compute(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = as_texts(part)
            out = []
            for original, value, (_, spans) in zip(part, texts, find(shared.value, texts)):
                pieces, at = [], 0
                for a, kind, b in spans:
                    if a >= at:
                        pieces += [value[at:a], f"<{KINDS[kind]}>"]
                    at = max(at, b)
                out.append("".join([*pieces, value[at:]]) if isinstance(original, str) else None)
            yield pd.Series(out, dtype=object)

    return compute(text)
