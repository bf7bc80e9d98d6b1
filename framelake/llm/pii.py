"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

1. Candidates. Fixed patterns propose spans of five kinds: email, ip, card, phone and secret (keys and passwords
   that identify a person's account). The *base* spans are those of the fixed rules for the first four kinds; they stay.
   The others are looser: obfuscated addresses, numbers with local phone or card shapes, assignments, credentials in URLs and long keys.
   Every scan is linear in the text.
2. Labelers vote on each candidate: 1 personal, -1 not, 0 no opinion. A regex labeler knows the strict forms, a checksum labeler
   Luhn, ranges and how varied a key is, a gazetteer labeler domain endings, card issuers, calling codes, special networks and key prefixes, two context
   labelers words around the span in four languages, and one whether the span stands alone. All lists are in a `Lexicon`, a parameter.
3. The votes of all candidates of all documents are counted by pattern; there are at most 3^labelers patterns for each
   kind, so the counts are a small table. Expectation-maximisation on it gives for each kind the share of
   personal spans and each labeler's reliabilities (the chance of its votes on personal and on other spans).
4. The posterior of each pattern is the soft label on which a logistic regression is trained, on at most `max_trained` distinct candidates, chosen
   by hash. It sees what no labeler does: hashed n-grams of the span's characters and of its shape, the words before and after it and the
   characters before it, besides the votes. The classifier decides on the looser candidates.

Whole texts are scanned twice, with no shuffle of text. Results list spans as kind:start:end in code points.

Defined cases: a null text is the empty text; without candidates nothing is trained and nothing is found; repeated rows are
judged one by one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import Scratch, read, ship

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")  # never fails, so never starts again inside a number
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser candidates; each begins with something rare, so that scanning long texts stays cheap.
_HIDDEN_AT = re.compile(r" ?[\[(]at[\])] ?[A-Za-z0-9-]{2,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{2,63})+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}|0[0-9]{1,4}[ /-][0-9]{5,9}|00[1-9][0-9 ]{8,16}[0-9])(?![0-9])")
_ASSIGNED = re.compile(r"(?i)(?:password|passwort|passwd|pwd|token|secret|api_?-?key|bearer|clave|contrase\u00f1a|mot de passe)\s?[=:]?\s?[\"']?([A-Za-z0-9+/_-]{8,})[\"']?")
_KEY = re.compile(r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20}|sk_live_[A-Za-z0-9]{16,})\b")
_CREDENTIALS = re.compile(r"://([^\s/@:]{1,64}:[^\s/@]{3,64})@")
_NUMBER = re.compile(r"[0-9](?:[ ()/.-]*+[0-9])++")
#: What texts with assignments or keys contain; a search for these costs less than the patterns.
_ASSIGNING = ("passw", "pwd", "token", "secret", "api_key", "api-key", "apikey", "bearer", "clave", "contrase", "mot de passe")
_KEYED = ("AKIA", "ASIA", "gho_", "ghp_", "ghs_", "ghu_", "xox", "AIza", "glpat-", "sk_live_")


@dataclass(frozen=True)
class Lexicon:
    """What the gazetteer and context labelers know."""

    endings: frozenset = frozenset(
        "com org net edu gov mil int info biz name pro io ai app dev co me tv cc eu de at ch li fr be nl lu it es pt gr uk ie dk se no fi is pl cz sk hu ro bg hr si rs ua ru tr il in cn jp kr tw hk sg my th vn id ph au nz ca us mx br ar cl pe za ng ke eg ma".split()
    )
    #: (first digits from, to, numbers of digits)
    issuers: tuple = (("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14,)), ("6011", "6011", (16, 19)), ("644", "659", (16, 19)), ("3528", "3589", (16,)))
    #: networks that no person has: (first parts from, to)
    networks: tuple = (((0,), (0,)), ((10,), (10,)), ((127,), (127,)), ((169, 254), (169, 254)), ((172, 16), (172, 31)), ((192, 0, 2), (192, 0, 2)), ((192, 168), (192, 168)), ((198, 18), (198, 19)), ((198, 51, 100), (198, 51, 100)), ((203, 0, 113), (203, 0, 113)), ((224,), (255,)))
    #: calling codes of one and two digits; those of three begin with two digits that are none of these
    codes: frozenset = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
    no_codes: frozenset = frozenset("28 83 89".split())
    #: whole words before or after a span, in English, German, French and Spanish
    context: tuple = (
        ("email", ("mail", "email", "e-mail", "contact", "write to", "reach", "kontakt", "schreib", "schreiben", "correo", "escriba", "escribe", "courriel", "contacter", "contactez")),
        ("ip", ("ip", "host", "logged in", "login", "client", "visitor", "besucher", "angemeldet", "connexion", "visiteur", "sesi\u00f3n", "conectado")),
        ("card", ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "paid with", "karte", "kreditkarte", "zahlung", "tarjeta", "pago", "carte", "paiement")),
        ("phone", ("phone", "telephone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "anruf", "telefon", "handy", "mobil", "llame", "llamar", "tel\u00e9fono", "m\u00f3vil", "appel", "appelez", "t\u00e9l\u00e9phone", "portable")),
        ("secret", ("password", "passwort", "passwd", "pwd", "token", "secret", "key", "api_key", "api-key", "apikey", "login", "credential", "credentials", "clave", "contrase\u00f1a", "mot de passe", "bearer")),
    )
    against: tuple = ("version", "release", "isbn", "issn", "chapter", "kapitel", "page", "seite", "section", "figure", "table", "example only", "order", "bestellung", "commande", "pedido", "invoice", "rechnung", "facture", "serial", "part no", "lot", "article", "artikel", "checksum", "commit", "sha1", "md5", "build", "rfc", "id", "uuid")


@lru_cache(maxsize=64)
def _any_word(words: tuple) -> re.Pattern:
    return re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, words)) + r")(?![^\W_])")


LEXICON = Lexicon()
LABELERS = ("regex", "checksum", "gazetteer", "context", "against", "isolated")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _address(text: str) -> bool:
    """Whether no part is over 255; parts may be of any length."""
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in text.split(".")))


def _look_back(text: str, at: int, least: int) -> int:
    """Where the characters of a local part that end before `at` begin."""
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _emails(text: str) -> list[tuple[str, int, int]]:
    """As the pattern finds them: from each @ its host, then back over the local part as far as the address before."""
    out, done = [], 0
    for m in _AT.finditer(text):
        begin = _look_back(text, m.start(), done)
        if begin < m.start():
            out.append(("email", begin, m.end()))
            done = m.end()
    return out


def _ips(text: str) -> list[tuple[str, int, int]]:
    """As the pattern finds them: four parts at a time of each chain of numbers and dots."""
    out = []
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts, begin = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            found = ".".join(parts[k : k + 4])
            if _address(found):
                out.append(("ip", begin, begin + len(found)))
            begin += len(found) + 1
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed rules: by kind as listed, then by start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += _emails(text)
    if "." in text:
        out += _ips(text)
    out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates that overlap no base span, nor each other."""
    found = []
    if "at]" in text or "at)" in text:
        found += [("email", begin, m.end()) for m in _HIDDEN_AT.finditer(text) if m.start() - (begin := _look_back(text, m.start(), max(0, m.start() - 64))) >= 2]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(_digits(m[0])) <= 19]
    found += [("phone", *m.span()) for n in _NUMBER.finditer(text) if n.end() - n.start() >= 7 for m in _LOCAL_PHONE.finditer(text, max(0, n.start() - 1), n.end())]
    low = text.lower()
    if any(w in low for w in _ASSIGNING):
        found += [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text) if "=" in m[0] or ":" in m[0] or any(c.isdigit() for c in m[1])]
    if any(w in text for w in _KEYED):
        found += [("secret", *m.span()) for m in _KEY.finditer(text)]
    if "://" in text:
        found += [("secret", *m.span(1)) for m in _CREDENTIALS.finditer(text)]
    starts: list[int] = []  # of the stretches that base spans cover, which don't overlap
    ends: list[int] = []
    for start, end in sorted((s, e) for _, s, e in base):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    out, done = [], 0
    for kind, start, end in sorted(found, key=lambda x: (x[1], x[2], x[0])):
        k = bisect_left(starts, end) - 1
        if start >= done and (k < 0 or ends[k] <= start):
            out.append((kind, start, end))
            done = end
    return out


def _issued(digits: str, lexicon: Lexicon) -> bool:
    return any(low <= digits[: len(low)] <= high and len(digits) in sizes for low, high, sizes in lexicon.issuers)


def _special(parts: tuple[int, ...], lexicon: Lexicon) -> bool:
    return any(low <= parts[: len(low)] <= high for low, high in lexicon.networks)


def _called(digits: str, lexicon: Lexicon) -> bool:
    """Whether international digits begin with a calling code."""
    return digits[:1] in lexicon.codes or digits[:2] in lexicon.codes or digits[:1] in set("2345689") and digits[:2] not in lexicon.no_codes


def votes(text: str, kind: str, start: int, end: int, lexicon: Lexicon = LEXICON) -> tuple[int, ...]:
    """The labelers' votes in the order of LABELERS. They look at the span's first 300 characters and at 60 around it."""
    span, before = text[start : min(end, start + 300)], text[max(0, start - 40) : start].lower()
    around = before + " " + text[end : end + 20].lower()
    digits = _digits(span)
    regex = checksum = gazetteer = 0
    if kind == "email":
        regex = 1 if _EMAIL.fullmatch(span) else 0
        ending = re.split(r"[^a-z0-9]+", span.lower())[-1]
        checksum = 1 if ending.isalpha() and 2 <= len(ending) <= 24 else -1
        gazetteer = 1 if ending in lexicon.endings else -1
    elif kind == "ip":
        regex = 1 if _IP.fullmatch(span) else 0
        proper = regex == 1 and _address(span) and all(p == "0" or p[0] != "0" for p in span.split("."))
        checksum = 1 if proper else -1
        gazetteer = (-1 if _special(tuple(map(int, span.split("."))), lexicon) else 1) if proper else 0
    elif kind == "card":
        regex = 1 if re.fullmatch(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}|[0-9]{13,19}", span) else -1
        checksum = 1 if luhn(digits) else -1
        gazetteer = 1 if _issued(digits, lexicon) else -1
    elif kind == "phone":
        regex = 1 if re.fullmatch(r"(?:\+|00)[1-9][0-9]{0,2}[ .-]?(?:\(?[0-9]{1,5}\)?[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,5}){1,4}", span) else 0
        checksum = 1 if 9 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
        if span[0] == "+" or span.startswith("00"):
            gazetteer = 1 if _called(digits.lstrip("0"), lexicon) else -1
    else:
        regex = 1 if _KEY.fullmatch(span) or re.fullmatch(r"[0-9a-f]{32,128}|[A-Za-z0-9+/_-]{20,}", span) and digits else 0
        checksum = 1 if len(set(span)) >= min(8, max(5, len(span) // 3)) and (bool(digits) or span != span.lower()) else -1
        gazetteer = 1 if _KEY.fullmatch(span) else -1 if span.isalpha() and span == span.lower() else 0
    context = 1 if _any_word(dict(lexicon.context)[kind]).search(around) else 0
    against = -1 if _any_word(lexicon.against).search(around) else 0
    alone = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return regex, checksum, gazetteer, context, against, 1 if alone else -1


BITS = 14
_SHAPES = str.maketrans({**{str(d): "0" for d in range(10)}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}})


def features(text: str, kind: str, start: int, end: int, vote: tuple[int, ...]) -> list[int]:
    """Places in the hash space: votes, n-grams of the span and its shape, words around it, characters before it. Each with its kind."""
    span = text[start : min(end, start + 80)]
    shape = span.translate(_SHAPES)
    low, before, after = span.lower(), text[max(0, start - 60) : start].lower(), text[end : end + 30].lower()
    words, following = re.findall(r"[^\W_]+", before)[-3:], re.findall(r"[^\W_]+", after)[:2]
    out = [f"v{i}{v}" for i, v in enumerate(vote)] + [f"n{min(end - start, 80) // 4}", f"f{low[:4]}", f"e{re.split(r'[^a-z0-9]+', low)[-1][-6:]}"]
    out += [f"s{shape[i : i + n]}" for n in (3, 5) for i in range(max(1, len(shape) - n + 1))]
    out += [f"c{low[i : i + 3]}" for i in range(max(1, len(low) - 2))] if kind in ("email", "secret") else []
    out += [f"b{k}{w}" for k, w in enumerate(reversed(words))] + [f"w{w}" for w in words] + [f"2{' '.join(words[-2:])}", f"a{following[0] if following else ''}"]
    out += [f"l{before[-n:]}" for n in (1, 2, 4)] + [f"r{after[:1]}"]
    return sorted({zlib.crc32(f"{kind}|{x}".encode()) & ((1 << BITS) - 1) for x in out})


class Labels:
    """What EM has learnt from counts of (kind, votes), and the classifier from candidates' features and their posteriors."""

    def __init__(self, counts: dict[tuple, int], steps: int = 50):
        self.share, self.rates = {}, {}
        self.weights, self.bias = None, 0.0
        by_votes: dict[str, Counter] = {}
        for (kind, v), n in counts.items():
            by_votes.setdefault(kind, Counter())[v] += n
        for kind, table in by_votes.items():
            self._maximise(kind, table, steps)

    def _maximise(self, kind: str, table: Counter, steps: int) -> None:
        patterns = np.array(list(table))
        n = np.array(list(table.values()), float)
        # starts from the labelers' majority; the rates keep a pseudo-count for every vote
        share, post = 0.5, _sigmoid(1.5 * patterns.sum(axis=1) - 1.0)
        for _ in range(steps):
            rates = np.empty((2, patterns.shape[1], 3))
            for truth, weight in enumerate((1 - post, post)):
                for vote in (-1, 0, 1):
                    rates[truth, :, vote + 1] = ((n * weight)[:, None] * (patterns == vote)).sum(axis=0) + 1
            rates /= rates.sum(axis=2, keepdims=True)
            share = ((n * post).sum() + 1) / (n.sum() + 2)
            columns = np.arange(patterns.shape[1])
            odds = np.log(share / (1 - share)) + (np.log(rates[1][columns, patterns + 1]) - np.log(rates[0][columns, patterns + 1])).sum(axis=1)
            post = _sigmoid(odds)
        self.share[kind], self.rates[kind] = share, rates

    def posterior(self, kind: str, vote: tuple[int, ...]) -> float:
        if kind not in self.rates:
            return 0.0
        rates, columns, v = self.rates[kind], np.arange(len(vote)), np.array(vote) + 1
        odds = np.log(self.share[kind] / (1 - self.share[kind])) + (np.log(rates[1][columns, v]) - np.log(rates[0][columns, v])).sum()
        return float(_sigmoid(odds))

    def train(self, samples: list[tuple[str, tuple[int, ...], list[int]]], steps: int = 120, decay: float = 3e-4) -> None:
        """samples: (kind, votes, features). Logistic regression on the posteriors by Adam."""
        if not samples:
            return
        owner = np.repeat(np.arange(len(samples)), [len(f) for _, _, f in samples])
        place = np.concatenate([np.array(f, np.int64) for _, _, f in samples])
        posterior: dict = {}
        y = np.array([posterior.setdefault((k, v), self.posterior(k, v)) for k, v, _ in samples])
        w, bias, moments = np.zeros(1 << BITS), 0.0, np.zeros((2, 1 << BITS))
        mb = vb = 0.0
        for step in range(1, steps + 1):
            error = (_sigmoid(np.bincount(owner, weights=w[place], minlength=len(y)) + bias) - y) / len(y)
            slope = np.bincount(place, weights=error[owner], minlength=1 << BITS) + decay * w
            moments[0] = 0.9 * moments[0] + 0.1 * slope
            moments[1] = 0.99 * moments[1] + 0.01 * slope**2
            mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.99 * vb + 0.01 * error.sum() ** 2
            a, b = 1 - 0.9**step, 1 - 0.99**step
            w -= 0.1 * (moments[0] / a) / (np.sqrt(moments[1] / b) + 1e-9)
            bias -= 0.1 * (mb / a) / (np.sqrt(vb / b) + 1e-9)
        self.weights, self.bias = w.astype(np.float32), float(bias)

    def probability(self, places: list[int]) -> float:
        return 0.0 if self.weights is None else float(_sigmoid(self.weights[places].sum() + self.bias))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def learn(docs: DataFrame, *, text_col="text", lexicon: Lexicon = LEXICON, max_trained: int = 20_000) -> Labels:
    """EM on the votes of all candidates of all documents; the classifier on at most max_trained distinct ones, chosen by hash."""
    spark = docs.sparkSession
    ship(spark)

    def propose(batches):
        names = ["kind", "votes", "places"]
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    for kind, start, end in base + loose_spans(text, base):
                        vote = votes(text, kind, start, end, lexicon)
                        rows.append((kind, vote, features(text, kind, start, end, vote)))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 3
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns, [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())])], names)

    with Scratch(spark, "pii") as work:
        found = work.keep(docs.select(F.col(text_col).cast("string")).mapInArrow(propose, "kind string, votes array<int>, places array<int>"), "candidates")
        # at most len(KINDS) * 3 ** len(LABELERS) rows, whatever the corpus
        table = found.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()
        labels = Labels({(r.kind, tuple(r.votes)): r.n for r in table})
        # distinct candidates below a limit of their hash: about 9 in 10 of max_trained over all tasks together, and never more than max_trained
        distinct = work.keep(found.distinct(), "distinct")
        total, order = distinct.count(), F.pmod(F.xxhash64("kind", "votes", "places"), F.lit(1 << 32))
        chosen = distinct if total <= max_trained else distinct.where(order < (9 * max_trained // 10 << 32) // total)
        rows = chosen.orderBy(order, "kind", "votes", "places").limit(max_trained).toArrow().to_pylist()
        labels.train([(r["kind"], tuple(r["votes"]), r["places"]) for r in rows])
    return labels


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def spans_of(text: str | None, labels: Labels, threshold: float, lexicon: Lexicon = LEXICON) -> tuple[list, list]:
    """(base spans, all spans) of a text."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [(k, s, e) for k, s, e in loose_spans(text, base) if labels.probability(features(text, k, s, e, votes(text, k, s, e, lexicon))) >= threshold]
    return base, base + more


def find_pii(docs: DataFrame, labels: Labels, *, id_col="doc_id", text_col="text", threshold: float = 0.5, lexicon: Lexicon = LEXICON) -> DataFrame:
    """A row for each document: doc_id, counts of base spans by kind, base_sha256, spans, n_spans."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(labels)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]

    def find(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = spans_of(text, shared.value, threshold, lexicon)
                n = Counter(k for k, _, _ in base)
                rows.append((*(n[k] for k in KINDS[:4]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans)))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()])], names)

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(find, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, labels: Labels, *, text_col="text", threshold: float = 0.5, lexicon: Lexicon = LEXICON) -> DataFrame:
    """docs, with each span of the text replaced by its kind in angle brackets; other columns unchanged."""
    ship(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(labels), docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def clean(batches):
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                pieces, done = [], 0
                for kind, start, end in sorted(spans_of(text, shared.value, threshold, lexicon)[1], key=lambda x: (x[1], -x[2])):
                    if start >= done:
                        pieces += [text[done:start], f"<{kind}>"]
                    done = max(done, end)
                texts.append(text if text is None else "".join([*pieces, text[done:]]))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)


def op10_pii(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return find_pii(docs, learn(docs))
