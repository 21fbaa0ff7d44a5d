"""Personal data by weak supervision (operator 1).

Candidates come from patterns: four base kinds with exact rules, which always count, and looser kinds (secrets, local
phone numbers, spelled-out e-mail addresses, national ids, account numbers).  Six labelers vote yes, no or nothing on
each candidate: a strict pattern, a checksum, gazetteers, cue words near it for and against, and its shape.
Expectation-maximisation over all candidates of all documents estimates how each labeler votes on true and on false
candidates; the posteriors are the soft labels of a logistic span classifier over kind, votes, length and digit share.
Looser candidates that the classifier accepts join the base spans.

Votes and features are discrete, so a candidate is one of at most ``CODES`` codes; tasks count codes, and only that
bounded table reaches the driver.  Every scan is linear in the text.

Edge cases: a null or empty text has no spans; a table without candidates trains nothing and accepts nothing; rows that
repeat a doc_id are judged one by one, and doc_id may be null; other columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone", "secret", "phone_local", "email_spelled", "national_id", "account")
BASE = 4
LABELERS = 6
LENGTHS, DIGITS = 6, 4
CODES = len(KINDS) * 3**LABELERS * LENGTHS * DIGITS

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = {
    "secret": re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+"),
    "phone_local": re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "email_spelled": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(] ?(?:dot|DOT) ?[\])] ?)[A-Za-z0-9-]{2,}+)+"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
#: Cue words that speak for and against each kind, and gazetteers.
_FOR = {
    "email": ("mail", "contact", "write", "schreib", "correo", "courriel", "@"),
    "ip": ("ip", "host", "server", "address", "adresse", "log"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "handy", "llam", "appel"),
    "secret": ("token", "secret", "key", "password", "passwd", "pwd", "auth", "bearer", "credential"),
    "phone_local": ("tel", "phone", "call", "fax", "mobile", "handy", "llam", "appel"),
    "email_spelled": ("mail", "contact", "write", "schreib", "correo", "courriel"),
    "national_id": ("ssn", "social", "security", "insurance", "identity"),
    "account": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
_AGAINST = ("version", "section", "isbn", "issn", "doi", "figure", "table", "chapter", "commit", "sha", "md5", "checksum", "example")
_DOMAINS = frozenset("com org net edu gov io info biz de fr es it uk eu us ca nl ch at be".split())
_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split())
_KEYS = re.compile(r"(?:token|secret|key|password|passwd|pwd|auth|bearer)\"?'? ?[:=] ?[\"']?\Z", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping spans of the base kinds; matches that fail a kind's condition are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS[:BASE]}
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out["email"].append((start, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out["phone"].append(m.span())
    return out


def _overlaps(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    return any(x < b and a < y for x, y in spans)


def loose_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Candidates of the other kinds, none of which overlaps a base span."""
    taken = sorted(s for spans in base.values() for s in spans)
    starts = np.array([a for a, _ in taken])
    ends = np.maximum.accumulate(np.array([b for _, b in taken])) if taken else starts
    free = lambda a, b: not len(starts) or not (k := int(np.searchsorted(starts, b))) or ends[k - 1] <= a
    out = {}
    for kind, pattern in _LOOSE.items():
        found = [m.span() for m in pattern.finditer(text) if free(*m.span())]
        if kind == "secret":
            found = [(a, b) for a, b in found if (w := text[a:b]) and any(c.isdigit() for c in w) and any(c.isalpha() for c in w)]
        out[kind] = found
    return out


def _mod97(account: str) -> bool:
    a = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1


def code_of(kind: str, text: str, a: int, b: int) -> int:
    """Votes (0 no, 1 nothing, 2 yes) and features of a candidate as one number."""
    span = text[a:b]
    digits = [c for c in span if "0" <= c <= "9"]
    before, around = text[max(0, a - 40) : a].lower(), (text[max(0, a - 60) : a] + " " + text[b : b + 30]).lower()
    variety = len(set(span)) / max(1, min(len(span), 16))
    strict = {"secret": bool(re.fullmatch(r"[0-9a-fA-F]{32,64}|[A-Za-z0-9_-]{36,}", span)), "phone_local": span[0] == "(", "email_spelled": span.lower().count("dot") > 0 or "." in span, "national_id": span[:3] not in ("000", "666") and span[0] != "9", "account": 18 <= len(span.replace(" ", "")) <= 34}.get(kind, True)
    if kind == "card":
        check = 2
    elif kind == "account":
        check = 2 if _mod97(span) else 0
    elif kind == "national_id":
        check = 0 if span[4:6] == "00" or span[7:] == "0000" else 1
    else:
        check = 1
    if kind == "email":
        listed = 2 if span.rpartition(".")[2].lower() in _DOMAINS else 1
    elif kind == "secret":
        listed = 2 if _KEYS.search(text[max(0, a - 24) : a]) else 1
    elif kind == "account":
        listed = 2 if span[:2] in _COUNTRIES else 0
    elif kind == "email_spelled":
        listed = 2 if re.split(r"[^A-Za-z0-9]+", span)[-1].lower() in _DOMAINS else 1
    else:
        listed = 1
    cue = 2 if any(w in before for w in _FOR[kind]) else 1
    against = 0 if any(w in around for w in _AGAINST) else 1
    shape = 2 if variety >= 0.5 else 0 if variety < 0.25 else 1
    votes = 0
    for v in (2 if strict else 0, check, listed, cue, against, shape):
        votes = 3 * votes + v
    length = min(LENGTHS - 1, max(0, len(span).bit_length() - 2))
    share = min(DIGITS - 1, DIGITS * len(digits) // max(1, len(span)))
    return ((KINDS.index(kind) * 3**LABELERS + votes) * LENGTHS + length) * DIGITS + share


def _unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    share, rest = codes % DIGITS, codes // DIGITS
    length, rest = rest % LENGTHS, rest // LENGTHS
    votes = np.stack([rest // 3 ** (LABELERS - 1 - k) % 3 for k in range(LABELERS)], 1)
    return rest // 3**LABELERS, votes, length, share


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM: the posterior that a candidate of each code is true.  Votes are independent given the truth; priors by kind."""
    kind, votes, _, _ = _unpack(codes)
    yes, no = (votes == 2).sum(1), (votes == 0).sum(1)
    post = np.where(kind < BASE, 0.95, (1 + 2 * yes) / (2 + 2 * yes + 2 * no))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = (np.bincount(kind, counts * post, len(KINDS)) + 1) / (np.bincount(kind, counts, len(KINDS)) + 2)
        log = np.stack([np.log(1 - prior)[kind], np.log(prior)[kind]])
        for j in range(LABELERS):
            seen = np.stack([np.bincount(votes[:, j], w, 3) for w in weight])
            p = (seen + [[2, 2, 1], [1, 2, 2]]) / (seen.sum(1, keepdims=True) + 5)
            # no labeler may be worse than chance, else true and false could change places
            pooled = (seen.sum(0) + 1) / (seen.sum() + 3)
            if p[0, 2] > p[1, 2]:
                p[:, 2] = pooled[2]
            if p[1, 0] > p[0, 0]:
                p[:, 0] = pooled[0]
            log += np.log(p)[:, votes[:, j]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post


def _features(codes: np.ndarray) -> np.ndarray:
    kind, votes, length, share = _unpack(codes)
    parts = [np.eye(len(KINDS))[kind], *(np.eye(3)[votes[:, j]] for j in range(LABELERS)), np.eye(LENGTHS)[length], np.eye(DIGITS)[share]]
    return np.concatenate(parts, 1)


def train(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of the logistic span classifier on soft labels (Newton steps, ridge 1)."""
    x, y = _features(codes), reliabilities(codes, counts)
    w = np.zeros(x.shape[1])
    size = counts / counts.sum() * min(counts.sum(), 1e6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (size * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (size * (p - y)) + w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _candidates(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    base = base_spans(text)
    return base, loose_spans(text, base)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[int] = Counter()
    for batch in batches:
        for text in batch.column(1).to_pylist():
            for found in _candidates(text):
                seen.update(code_of(kind, text, a, b) for kind, spans in found.items() for a, b in spans)
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["code", "n"])


def fit(docs: DataFrame) -> np.ndarray | None:
    """The classifier's weights, from the candidates of all rows; None if there are none."""
    C.small_batches(docs.sparkSession)
    counted = C.id_text(docs).mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    if not len(counted):
        return None
    counted = counted.sort_values("code")
    return train(counted["code"].to_numpy(), counted["n"].to_numpy().astype(float))


def _accepted(text: str, loose: dict[str, list[tuple[int, int]]], weights: np.ndarray | None) -> dict[str, list[tuple[int, int]]]:
    if weights is None:
        return {}
    out = {}
    for kind, spans in loose.items():
        if spans:
            yes = _features(np.array([code_of(kind, text, a, b) for a, b in spans])) @ weights >= 0
            out[kind] = [s for s, ok in zip(spans, yes, strict=True) if ok]
    return out


def _joined(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(found.get(k, ())))


def _find(weights: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, spans = [], [], []
            for text in batch.column(1).to_pylist():
                base, loose = _candidates(text)
                counts.append([len(base[k]) for k in KINDS[:BASE]])
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(base | _accepted(text, loose, weights)))
            numbers = zip(*counts, strict=True) if counts else [[]] * BASE
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in numbers), pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans for every row of ``docs``."""
    weights = fit(docs)
    return C.id_text(docs).mapInArrow(_find(weights), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _hide(weights: np.ndarray | None, column: str):
    def hidden(text: str) -> str:
        base, loose = _candidates(text)
        spans = sorted((a, b, k) for k, found in (base | _accepted(text, loose, weights)).items() for a, b in found)
        out, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                out.append(f"{text[at:a]}<{kind.upper()}>")
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(column)
            new = pa.array([None if t is None else hidden(t) for t in batch.column(k).to_pylist()], batch.schema.field(k).type)
            yield batch.set_column(k, batch.schema.field(k), new)

    return run


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span, base or accepted, replaced by its kind in angle brackets; spans that overlap merge."""
    return docs.mapInArrow(_hide(fit(docs), "text"), docs.schema)
