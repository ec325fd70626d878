"""Personal data by weak supervision.

Base spans come from four strict patterns (email, ip, card, phone) and always stay. Further candidates come from loose
patterns: long mixed strings (secret), numbers in groups without a plus sign (loose_phone), addresses written out like "mail (at)
domain dot com" (loose_email), account numbers whose checksum fits (iban), and numbers grouped like national ones (national). Three kinds of labelers vote on each candidate (1 personal, -1 not, 0 abstains): a regex, a
gazetteer of words before it, and its context and shape. Expectation-maximisation estimates the labelers' reliabilities from
the counts of vote patterns over all documents; its posteriors are the soft labels on which the final span classifier, a
logistic regression over features of the span, is trained. A candidate becomes a span if the classifier gives it at least
`least`. Vote patterns and feature combinations are few (the bounds are VOTES and FEATURES), so both fits work on counts, and
every candidate of the corpus takes part in them.

Edge cases: a null text is empty. Candidates that overlap a base span are dropped; of overlapping ones the first stays, of those the longest. Texts
without spans have the hash of the empty string and empty spans. Repeated rows are treated alike. An empty table gives an
empty result. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antiphon.llm import _common as C

KINDS = ("email", "ip", "card", "phone")
LOOSE = ("loose_email", "loose_phone", "secret", "iban", "national")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
_LOOSE_PHONE = re.compile(
    r"(?<![0-9+(.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"
    r"|(?<![0-9A-Za-z+(./-])(?:\(0[0-9]{1,4}\)|0[0-9]{1,4})[ /-][0-9]{5,9}(?![0-9.-])"
)
#: What stands for @ and for a point, written out; " at " and " dot " only count together.
_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}) ?| at ", re.I)
_POINT = r" ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot "
_POINT_BEFORE = re.compile(f"(?:{_POINT})\\Z", re.I)
_HOST = re.compile(rf"[A-Z0-9-]++(?:(?:{_POINT}|\.)[A-Z0-9-]++)++", re.I)
_HAS_POINT = re.compile(_POINT, re.I)
_LAST_LABEL = re.compile(r"[A-Za-z]{2,}\Z")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
#: How far before a long string the address is looked for that it's a part of.
_NEAR = 2_048
# Words that announce each kind.
GAZETTEER = {
    "secret": "token secret key apikey api_key password passwd pwd bearer credential credentials auth authorization access private passwort kennwort schlüssel geheim contraseña clave secreto jeton clé motdepasse".split(),
    "loose_phone": "phone tel telephone call calls called mobile cell fax dial ring sms whatsapp number telefon handy rufnummer anrufen durchwahl nummer teléfono móvil llamar llame número téléphone portable appeler appelez numéro".split(),
    "loose_email": "email mail contact write reach address send kontakt schreiben adresse correo escribir escriba dirección courriel écrire écrivez adresse contacter".split(),
    "iban": "iban account bank transfer konto kontonummer überweisung cuenta transferencia compte virement".split(),
    "national": "ssn social security insurance id identity number ausweis versicherung steuernummer seguro identidad sécurité sociale".split(),
}
_STRICT = {
    "secret": re.compile(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}", re.I),
    "loose_phone": re.compile(r"\([0-9]{3}\)[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-]555[ .-][0-9]{4}|\(0[0-9]{1,4}\)[ /-][0-9]{5,9}"),
    "loose_email": re.compile(r".*[(\[{]at[)\]}].*[(\[{]dot[)\]}].*", re.I),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]+"),
    "national": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
}
LABELERS = ("regex", "gazetteer", "context", "shape")
VOTES = 3 ** len(LABELERS) * len(LOOSE)
#: Of a span: kind, length, share of digits, distinct characters, what stands before it, a quotation mark around it, an announcing word.
WIDTHS = (len(LOOSE), 6, 5, 5, 4, 2, 2)
FEATURES = math.prod(WIDTHS)
LEAST = 0.5
FOUND = "doc_id long, base array<struct<kind int, begin int, end int>>, loose array<struct<kind int, begin int, end int, votes int, features int>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, begin, end) by kind, then begin. Each is linear in the text's length, also for long runs of one character."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        # The leftmost match begins where the run of local characters before the @ does.
        begin = at
        while begin > done and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            out.append((0, begin, domain.end()))
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)
    if not re.search("[0-9]", text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m.group())) <= 15]
    return out


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def iban(text: str) -> bool:
    """Whether the checksum fits: of the letters as numbers, with the first four at the end, 1 modulo 97."""
    bare = text.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def written_out(text: str) -> Iterator[tuple[int, int]]:
    """Addresses whose @ is written out, with all labels of their names: linear, from each sign to both sides."""
    done = 0
    for m in _AT.finditer(text):
        begin = m.start()
        while True:
            here = begin
            while begin > done and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
                begin -= 1
            point = _POINT_BEFORE.search(text[max(done, begin - 7) : begin]) if begin < here else None
            if not point or point.end() - point.start() >= begin - done or not text[begin - (point.end() - point.start()) - 1].isalnum():
                break
            begin -= point.end() - point.start()
        while begin < m.start() and text[begin] in ".-":
            begin += 1
        host = _HOST.match(text, m.end())
        if begin == m.start() or not host or not _LAST_LABEL.search(host.group()):
            continue
        if m.group().strip().lower() == "at" and not _HAS_POINT.search(host.group()):
            continue
        done = host.end()
        yield begin, done


def _in_address(text: str, begin: int) -> bool:
    """Whether what begins there is part of an url, but not a value in it."""
    before = text[max(0, begin - _NEAR) : begin]
    return bool(before) and not before[-1].isspace() and before[-1] != "=" and "://" in before.split()[-1]


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(kind, begin, end, votes, features) of candidates that overlap neither base spans nor each other."""
    found = [(m.start(), m.end(), 2) for m in _SECRET.finditer(text) if not _in_address(text, m.start())]
    if re.search("[0-9]", text):
        found += [(m.start(), m.end(), 1) for m in _LOOSE_PHONE.finditer(text)]
        found += [(m.start(), m.end(), 3) for m in _IBAN.finditer(text) if iban(m.group())]
        found += [(m.start(), m.end(), 4) for m in _NATIONAL.finditer(text)]
    found += [(b, e, 0) for b, e in written_out(text)]
    busy = sorted((b, e) for _, b, e in taken)
    out, at, done = [], 0, 0
    for begin, end, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2] != LOOSE.index("iban"), x[2])):
        while at < len(busy) and busy[at][1] <= begin:
            at += 1
        if begin < done or at < len(busy) and busy[at][0] < end:
            continue
        done = end
        out.append((kind, begin, end, *_look(text, begin, end, kind)))
    return out


def _look(text: str, begin: int, end: int, kind: int) -> tuple[int, int]:
    span, before, after = text[begin:end], text[max(0, begin - 32) : begin], text[end : end + 1]
    name = LOOSE[kind]
    digits = sum(c.isdigit() for c in span)
    distinct, entropy = len(set(span)), _entropy(span)
    announced = any(w in re.split(r"[^\w]+", before.lower()) for w in GAZETTEER[name])
    last = before.rstrip(" ")[-1:]
    quoted = last in ('"', "'", "`") and after == last
    sets = before.rstrip(" \"'`")[-1:] in ("=", ":")
    letters = any(c.isalpha() for c in span)
    votes = (
        1 if _STRICT[name].fullmatch(span) else 0,
        1 if announced else 0,
        1 if sets or quoted and announced else -1 if last == "/" or after in ("/", "|") else 0,
        (1 if entropy >= 3 and digits and letters else -1 if entropy < 2.2 or not digits else 0) if name == "secret" else (1 if distinct >= 6 or name == "iban" else -1 if distinct <= 3 else 0),
    )
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    share = digits / len(span)
    place = 0 if not last else 1 if last in "=:" else 2 if last in "\"'`" else 3
    values = (kind, min(5, len(span) // 10), min(4, int(share * 5)), min(4, distinct // 4), place, int(quoted), int(announced))
    features = 0
    for v, width in zip(values, WIDTHS):
        features = features * width + v
    return code, features


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = [("kind", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]
    for batch in C.chunks(batches):
        base, loose = [], []
        for text in batch.column(1).to_pylist():
            own = base_spans(text)
            base.append([{"kind": k, "begin": b, "end": e} for k, b, e in own])
            loose.append([{"kind": k, "begin": b, "end": e, "votes": v, "features": f} for k, b, e, v, f in loose_spans(text, own)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(pa.struct(span))), pa.array(loose, pa.list_(pa.struct([*span, ("votes", pa.int32()), ("features", pa.int32())])))], names=["doc_id", "base", "loose"])


def _unpack(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind and votes (rows of -1, 0, 1)."""
    votes = []
    for _ in LABELERS:
        votes.append(code % 3 - 1)
        code = code // 3
    return code, np.stack(votes[::-1], 1)


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of "personal" for each vote pattern, by expectation-maximisation; labelers vote independently given the truth."""
    kind, votes = _unpack(codes)
    posterior = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    for _ in range(rounds):
        log_odds = np.zeros(len(codes))
        for k in range(len(LOOSE)):
            mine = kind == k
            w = counts * mine
            share = np.clip(((posterior * w).sum() + 1) / (w.sum() + 2), 0.01, 0.99)
            log_odds[mine] += np.log(share / (1 - share))
        for j in range(len(LABELERS)):
            for v in (-1, 0, 1):
                hit = votes[:, j] == v
                # Smoothed towards labelers that are right more often than not.
                yes = ((posterior * counts)[hit].sum() + 2 + v) / ((posterior * counts).sum() + 6)
                no = (((1 - posterior) * counts)[hit].sum() + 2 - v) / (((1 - posterior) * counts).sum() + 6)
                log_odds[hit] += np.log(yes / no)
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return posterior


def _one_hot(features: np.ndarray) -> np.ndarray:
    columns = []
    for width in WIDTHS[::-1]:
        columns.append(np.eye(width)[features % width])
        features = features // width
    return np.concatenate([np.ones((len(features), 1)), *columns[::-1]], 1)


def train(features: np.ndarray, counts: np.ndarray, soft: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on counts with soft labels, by Newton's method."""
    x = _one_hot(features)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (counts * (p - soft)) + ridge * w
        w -= np.linalg.solve((x.T * (counts * np.maximum(p * (1 - p), 1e-6))) @ x + ridge * np.eye(len(w)), grad)
    return w


def _counts(found: DataFrame) -> DataFrame:
    return found.select(F.explode("loose").alias("x")).groupBy("x.votes", "x.features").agg(F.count("*").alias("n")).orderBy("votes", "features")


def all_spans(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, base, extra (each an array of kind, begin, end); kinds of extra go on after those of base."""
    found = C.keep(C.text_frame(docs).mapInArrow(_find, FOUND), "pii-found")
    # At most VOTES * FEATURES rows, whatever the input.
    rows = _counts(found).collect()
    good = _decide([tuple(r) for r in rows], least)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = set(good)
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            extra = [[{"kind": len(KINDS) + x["kind"], "begin": x["begin"], "end": x["end"]} for x in row or [] if x["features"] in kept] for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(extra, kind)], names=["doc_id", "base", "extra"])

    span = "array<struct<kind int, begin int, end int>>"
    return found.mapInArrow(choose, f"doc_id long, base {span}, extra {span}")


def _line(spans: list[dict]) -> str:
    names = KINDS + LOOSE
    return ",".join(f"{names[s['kind']]}:{s['begin']}:{s['end']}" for s in sorted(spans, key=lambda s: (s["kind"], s["begin"])))


def find_pii(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, extra = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            counts = [[sum(s["kind"] == k for s in row) for row in base] for k in range(len(KINDS))]
            hashes = [hashlib.sha256(_line(row).encode()).hexdigest() for row in base]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array([_line(b + e) for b, e in zip(base, extra)], pa.string()), pa.array([len(e) for e in extra], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_extra"])

    return all_spans(docs, least=least).mapInArrow(digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_extra long")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans make one, named by the first."""
    names, out, at = KINDS + LOOSE, [], 0
    for begin, end, kind in sorted((b, e, k) for k, b, e in spans):
        if begin >= at:
            out += [text[at:begin], f"[{names[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked_documents(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with personal data masked in text (null stays null) and n_chars (where it's there) counted anew; all other columns as they are."""
    yes = _decide([tuple(r) for r in _counts(C.text_frame(docs).mapInArrow(_find, FOUND)).collect()], least)

    @F.pandas_udf("string")
    def masked(text):  # noqa: ANN001, ANN202
        kept = set(yes)

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            own = base_spans(t)
            return mask(t, own + [(len(KINDS) + k, b, e) for k, b, e, _, f in loose_spans(t, own) if f in kept])

        return text.map(one)

    out = docs.withColumn("text", masked(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _decide(rows: list[tuple[int, int, int]], least: float) -> list[int]:
    """The feature combinations that the classifier trained on these counts (votes, features, n) calls personal."""
    if not rows:
        return []
    votes, features, n = np.array(rows, np.int64).T
    codes, back = np.unique(votes, return_inverse=True)
    posterior = reliabilities(codes, np.bincount(back, n))[back]
    weights = train(features, n.astype(float), posterior)
    return np.flatnonzero(1 / (1 + np.exp(-_one_hot(np.arange(FEATURES)) @ weights)) >= least).tolist()
