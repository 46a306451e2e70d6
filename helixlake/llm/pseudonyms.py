"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their kind's checks (and e-mail names, keys and passwords) are permuted within their format
by a keyed Feistel network over the number of values that the format has, walking the cycle until a valid value comes
up. The permutation depends on the key and the kind alone, so equal values get equal pseudonyms in all documents,
different values get different ones, and the same key undoes it.

Kinds: card (13 to 19 digits, Luhn), iban (mod 97), phone (North American: with country code or brackets, or a possible number), ssn, ip
(dotted quad of version 4), date (ISO, and day/month/year or month/day/year with slashes or dots: the day moves within 1900 to 2099,
with years of four digits), email (name; the domain stays), key (cloud access keys, and values after token, secret,
password, passwd or api key in letters of any case). Numbers of other countries' phones, addresses of version 6 and years of two
digits are no kinds, and stay.

Defined cases: a null text stays null, an empty one empty; what fails its checks stays as it is; repeated rows and null
ids are rows like others; a text of any length is taken whole; an empty table gives an empty result; other columns pass
through untouched, but for one called pii, which the result replaces.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import bound_batches

ROUNDS = 8
#: Letters of a word that are still taken for one number.
LONG = 64


class Feistel:
    """A keyed permutation of 0 to size - 1: a balanced network on the least even number of bits, walked back into range."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
        self.size, self.mask = size, (1 << self.half) - 1
        self.mac = hmac.new(key, f"{kind}/{size}".encode(), hashlib.sha256)

    def _round(self, k: int, x: int) -> int:
        mac = self.mac.copy()
        mac.update(bytes([k]) + x.to_bytes(-(-self.half // 8), "big"))
        digest = mac.digest()
        while len(digest) * 8 < self.half:
            digest += hashlib.sha256(digest).digest()
        return int.from_bytes(digest, "big") & self.mask

    def _once(self, x: int, back: bool) -> int:
        a, b = x >> self.half, x & self.mask
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            a, b = (b ^ self._round(k, a), a) if back else (b, a ^ self._round(k, b))
        return a << self.half | b

    def permuted(self, x: int, back: bool = False) -> int:
        if self.size < 2:
            return x
        while (x := self._once(x, back)) >= self.size:
            pass
        return x


class LongFeistel:
    """A keyed permutation of words of `length` digits below `size`, for words too long to be taken for one number: halves of
    the digits are added in turn to streams keyed by the other half, in time proportional to the length."""

    def __init__(self, key: bytes, kind: str, size: int, length: int):
        self.mac, self.size, self.half = hmac.new(key, f"{kind}/{size}/{length}/long".encode(), hashlib.sha256), size, length // 2

    def _stream(self, k: int, other: np.ndarray, n: int) -> np.ndarray:
        mac = self.mac.copy()
        mac.update(bytes([k]) + other.astype("<u2").tobytes())
        return (np.frombuffer(hashlib.shake_256(mac.digest()).digest(8 * n), "<u8") % np.uint64(self.size)).astype(np.int64)

    def permuted(self, digits: np.ndarray, back: bool = False) -> np.ndarray:
        halves = [digits[: self.half], digits[self.half :]]
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            own, other = k % 2, 1 - k % 2
            stream = self._stream(k, halves[other], len(halves[own]))
            halves[own] = (halves[own] + (-stream if back else stream)) % self.size
        return np.concatenate(halves)


def luhn(digits: str) -> int:
    """0 for a valid number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _shaped(text: str, digits: str) -> str:
    """The digits put where text has digits."""
    take = iter(digits)
    return "".join(next(take) if c.isdigit() else c for c in text)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = key
        self.network = lru_cache(4096)(lambda kind, size: Feistel(key, kind, size))
        self.kinds: dict[str, Callable[[re.Match, bool], str | None]] = {
            "email": self._email, "key": self._key, "iban": self._iban, "ip": self._ip, "date": self._date, "ssn": self._ssn, "phone": self._phone, "card": self._card,
        }

    def _number(self, kind: str, digits: str, back: bool, valid: Callable[[str], bool] = lambda _: True) -> str:
        """Permutes among numbers of as many digits that are valid; walks on past those that aren't."""
        net, n = self.network(f"{kind}{len(digits)}", 10 ** len(digits)), len(digits)
        x = digits
        while not valid(x := str(net.permuted(int(x), back)).zfill(n)):
            pass
        return x

    def _letters(self, kind: str, word: str, alphabet: str, back: bool) -> str:
        size = len(alphabet)
        if len(word) > LONG:
            digits = np.array([alphabet.index(c) for c in word], np.int64)
            return "".join(map(alphabet.__getitem__, LongFeistel(self.key, kind, size, len(word)).permuted(digits, back).tolist()))
        x = 0
        for c in word:
            x = x * size + alphabet.index(c)
        x = self.network(f"{kind}{size}", size ** len(word)).permuted(x, back)
        out = []
        for _ in word:
            x, d = divmod(x, size)
            out.append(alphabet[d])
        return "".join(reversed(out))

    def _card(self, m: re.Match, back: bool) -> str | None:
        digits = re.sub("[^0-9]", "", m["card"])
        if luhn(digits) or len(set(digits)) < 2:
            return None

        def checked(body: str) -> str:
            return body + str(-luhn(body + "0") % 10)

        return _shaped(m["card"], checked(self._number("card", digits[:-1], back, lambda b: len(set(checked(b))) > 1)))

    def _iban(self, m: re.Match, back: bool) -> str | None:
        parts = m["iban"].split(" ")
        for k in range(len(parts), 0, -1):  # words in capitals may follow
            if made := self._valid_iban(" ".join(parts[:k]), back):
                return " ".join([made, *parts[k:]])
        return None

    def _valid_iban(self, text: str, back: bool) -> str | None:
        bare = text.replace(" ", "")
        if not 15 <= len(bare) <= 34 or int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 != 1:
            return None
        at = [k for k in range(4, len(bare)) if bare[k].isdigit()]
        body = list(bare)
        for k, d in zip(at, self._number("iban", "".join(bare[k] for k in at), back)):
            body[k] = d
        rest = "".join(str(int(c, 36)) for c in "".join(body[4:]) + bare[:2] + "00")
        body[2:4] = f"{98 - int(rest) % 97:02d}"
        take = iter(body)
        return "".join(c if c == " " else next(take) for c in text)

    def _phone(self, m: re.Match, back: bool) -> str | None:
        digits = re.sub("[^0-9]", "", m["phone"])
        country, national = digits[:-10], digits[-10:]
        valid = lambda x: x[0] in "23456789" and x[3] in "23456789"
        plain = not country and "(" not in m["phone"]
        if plain and not valid(national):
            return None
        # A number that no exchange can have is taken for one if it is written as one; it stays among its like.
        own = valid(national)
        return _shaped(m["phone"], country + self._number("phone", national, back, lambda x: valid(x) == own))

    def _ssn(self, m: re.Match, back: bool) -> str | None:
        valid = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
        digits = m["ssn"].replace("-", "")
        return _shaped(m["ssn"], self._number("ssn", digits, back, valid)) if valid(digits) else None

    def _ip(self, m: re.Match, back: bool) -> str | None:
        parts = m["ip"].split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        x = self.network("ip", 1 << 32).permuted(int.from_bytes(bytes(map(int, parts)), "big"), back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, m: re.Match, back: bool) -> str | None:
        first, last = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
        a, sep, b, c = m["d1"], m["sep"], m["d2"], m["d3"]
        orders = ("ymd",) if len(a) == 4 else ("dmy", "mdy")
        for order in orders:
            part = dict(zip(order, (a, b, c)))
            try:
                day = datetime.date(int(part["y"]), int(part["m"]), int(part["d"]))
            except ValueError:
                continue
            if not first <= day <= last:
                return None
            net = self.network("date", (last - first).days + 1)
            x = (day - first).days
            while True:  # a day that can be read in the other order would come back as another
                x = net.permuted(x, back)
                moved = first + datetime.timedelta(days=x)
                if order != "mdy" or moved.day > 12:
                    break
            wide = len(part["d"]) == 2 and len(part["m"]) == 2
            text = {"y": f"{moved.year:04d}", "m": f"{moved.month:02d}" if wide else str(moved.month), "d": f"{moved.day:02d}" if wide else str(moved.day)}
            return sep.join(text[k] for k in order)
        return None

    def _email(self, m: re.Match, back: bool) -> str | None:
        name, domain = m["email"].rsplit("@", 1)
        runs = re.split(r"([a-z]+|[A-Z]+|[0-9]+)", name)
        made = [
            self._letters("email", r, "abcdefghijklmnopqrstuvwxyz" if r.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if r.isupper() else "0123456789", back) if r and r.isascii() and r.isalnum() else r
            for r in runs
        ]
        return "".join(made) + "@" + domain

    def _key(self, m: re.Match, back: bool) -> str | None:
        whole = m["key"]
        value = m["k1"] or m["k2"]
        start = len(whole) - len(whole[whole.rindex(value) :])
        if m["k1"]:
            made = value[:4] + self._letters("key", value[4:], "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", back) if re.fullmatch("[A-Z2-7]+", value[4:]) else value[:4] + self._letters("key", value[4:], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", back)
        elif re.fullmatch("[0-9a-f]+", value):
            made = self._letters("key", value, "0123456789abcdef", back)
        else:
            made = self._letters("key", value, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-.", back)
        return whole[:start] + made + whole[start + len(value) :]

    PATTERN = re.compile(
        # A name begins where its run of characters does, so that no run is looked at from each of its letters.
        r"(?<![A-Za-z0-9._%+-])[._%+-]*(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
        r"|(?P<key>\b(?P<k1>A[KS]IA[A-Z0-9]{16})\b|\b(?i:token|secret|password|passwd|api[_-]?key)\b[\"']?\s*[=:]\s*[\"']?(?P<k2>[A-Za-z0-9+/=_.-]*[A-Za-z0-9+/=_-]))"
        r"|\b(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b"
        r"|(?<![\w.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![\w]|\.[0-9])"
        r"|(?<![\w./-])(?P<date>(?P<d1>[0-9]{4}|[0-9]{1,2})(?P<sep>[-/.])(?P<d2>[0-9]{1,2})(?P=sep)(?P<d3>[0-9]{4}|[0-9]{1,2}))(?![\w/-]|\.[0-9])"
        r"|(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"
        r"|(?<![\w+])(?P<phone>(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?!\w)"
        r"|(?<![\w.-])(?P<card>[0-9]{13,19}|[0-9]{4}(?P<cs>[ -])(?:[0-9]{4}(?P=cs)[0-9]{4}(?P=cs)[0-9]{1,7}|[0-9]{6}(?P=cs)[0-9]{5}))(?![\w-]|\.[0-9])"
    )

    def replaced(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and kind, start and end of each in the new text."""
        out: list[str] = []
        found: list[tuple[str, int, int]] = []
        at = size = 0
        for m in self.PATTERN.finditer(text):
            kind = m.lastgroup if m.lastgroup in self.kinds else next(k for k in self.kinds if m[k] is not None)
            made = self.kinds[kind](m, back)
            if made is None:
                continue
            out += [text[at : m.start(kind)], made]
            size += m.start(kind) - at
            found.append((kind, size, size + len(made)))
            size += len(made)
            at = m.end(kind)
        out.append(text[at:])
        return "".join(out), found


#: Every match of PATTERN holds one of these: an e-mail name has @, keys are of three kinds, and all else has digits.
HINT = re.compile(r"[0-9@]|A[KS]IA|(?i:token|secret|passw|key)")


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with the text replaced, and pii (kind, start, end in the new text), in place of a column of that name."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("pii")
    names = docs.columns
    at = names.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in batches:
            made = [own.replaced(t) if t and HINT.search(t) else (t, []) for t in (x.as_py() for x in batch.column(at))]
            arrays = list(batch.columns)
            arrays[at] = pa.array([t for t, _ in made], pa.string())
            arrays.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for _, f in made], kind))
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "pii"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "pii array<struct<kind:string,start:int,end:int>>"])
    return docs.mapInArrow(rows, schema)


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")


def pseudonym_report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_pii and a count for each kind, for every row of docs."""
    made = pseudonymise(docs.select(F.col("doc_id").cast("long"), "text"), key)
    kinds = list(Pseudonyms(key).kinds)
    return made.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), *[_count(k).alias(f"n_{k}") for k in kinds])
