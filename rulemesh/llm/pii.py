"""Surrogates for personal data.

Entities found by patterns are replaced in the text by keyed surrogates of
their own kind:

* telephones, cards, bank accounts and social security numbers keep their
  separators; digits go through a keyed Feistel permutation, so different
  numbers stay different and one number written in several ways stays one.
  Telephones keep country code and trunk zero and are known by the digits after
  them; cards keep the two digits of their issuer, and whether their check digit
  is right; IBANs keep country and letters (or, without any digit, their places)
  and whether their check digits are right;
* IPv4 addresses go through a permutation of the public addresses, or of the
  private block or loopback block that they are in;
* dates of birth go through a permutation of the days of 1900 to 2099;
* mail addresses get a keyed local part and, by domain, a keyed domain with the
  old top level;
* secrets (long hexadecimal strings, what follows a word like ``password=``,
  signed tokens, and access keys by their known beginnings) keep their length and
  at each place its class: digits, letters to f (so hexadecimal stays what it is)
  and after f, both in either case, other signs as they are. All characters go
  through a keyed Feistel permutation together; labels and beginnings stay;
* persons are found by a title, a well-known given name, or a family name that
  is written first; they have up to three names, with hyphens, apostrophes and
  particles. Each name has one surrogate of its script (Latin, Greek, Cyrillic),
  and what else in the text is one of its persons' names, alone, is replaced
  alike: "Mrs Mary Jane Poe left; Poe returned" keeps no "Poe". Given names have
  their gender's ending: that of the list of names, else that of their title,
  else a neutral one; their stem depends on the name alone.

Each permutation is a round trip about one step: through the rounds, one value
further, and back through the rounds. So no value is its own surrogate and no
two values of a kind share one, however many there are, and neither has to be
looked for. Names and mail addresses are hashed and could collide. A first pass
therefore collects their distinct values in the corpus, counts surrogates that
two of them share or that are a real value, and gives the kinds concerned
another, longer variant until none occurs. Only a count for each kind reaches
the driver. The variants belong to the key: who adds documents later passes the
ones chosen first, else the same entity may get another surrogate. The second
pass rewrites each text within its row, without a shuffle.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, fresh, read_table

#: The setting that holds the key, and what queries take without it, with a warning.
KEY_SETTING, EXAMPLE_KEY = "spark.rulemesh.surrogateKey", "example key"
#: Rounds of a permutation on the way to its step, and as many back; an odd number, as the step is one of the right side.
ROUNDS = 3

# Titles and well-known given names by gender, and family names that are written first.
MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|Don|Κύριος|Господин"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Doña|Κυρία|Госпожа"
OTHER_TITLES = "Dr|Prof"
MALE_NAMES = (
    "James|John|Robert|Michael|William|David|Richard|Thomas|Charles|Joseph|Daniel|Matthew|Anthony|Steven|Paul|Andrew|Joshua|Kenneth|Kevin|Brian|George|"
    "Edward|Ronald|Timothy|Jason|Jeffrey|Ryan|Jacob|Nicholas|Eric|Jonathan|Stephen|Hans|Peter|Klaus|Wolfgang|Jürgen|Stefan|Uwe|Heinz|Jean|Pierre|Michel|"
    "Jacques|François|Philippe|José|Juan|Carlos|Luis|Miguel|Javier|Mohammed|Ahmed|Иван|Дмитрий|Сергей|Алексей|Владимир|Γιώργος|Νίκος|Δημήτρης"
)
FEMALE_NAMES = (
    "Mary|Patricia|Jennifer|Linda|Elizabeth|Susan|Sarah|Karen|Jane|Jessica|Nancy|Margaret|Lisa|Betty|Sandra|Ashley|Kimberly|Emily|Donna|Michelle|Carol|"
    "Amanda|Melissa|Deborah|Stephanie|Rebecca|Laura|Cynthia|Anna|Ursula|Helga|Monika|Sabine|Petra|Gisela|Ingrid|Marie|Nathalie|Isabelle|Sylvie|Françoise|"
    "Camille|María|Carmen|Josefa|Ana|Lucía|Isabel|Fatima|Aisha|Ольга|Татьяна|Елена|Наталья|Мария|Μαρία|Ελένη|Κατερίνα"
)
FAMILY_FIRST = "Zhang|Wang|Li|Liu|Chen|Yang|Huang|Zhao|Wu|Zhou|Xu|Sun|Zhu|Nguyen|Tran|Kim|Park|Choi"
# Consonants, vowels and endings (male, female, other) of surrogate names by script.
SCRIPTS = {
    "latin": ("bdfgklmnprstvz", "aeiou", ("on", "a", "in")),
    "greek": ("βγδζκλμνπρστφχ", "αεηιο", ("ος", "α", "ι")),
    "cyrillic": ("бвгдзклмнпрстф", "аеиоу", ("ан", "а", "ин")),
}
# Country calling codes of one and two digits; all others have three.
CALLING_CODE = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
# What introduces a date of birth, what introduces a secret, and how access keys and tokens begin.
BORN = r"(?i:born(?: on)?|date of birth|dob|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)[:\s]{1,3}"
_LABEL = r"(?i:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)\s?[=:]\s?[\"']?"
_BEGINNING = r"(?:AKIA|ASIA|gh[pousr]_|sk-|eyJ)"

SECRET_HEAD = rf"^(?:{_LABEL}|{_BEGINNING})"
_TITLE = rf"(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.?\s"
_NAME = r"(?:\p{Lu}['’])?(?:\p{Lu}[\p{Ll}\p{M}]++){1,2}+(?:-\p{Lu}?[\p{Ll}\p{M}]++|['’]\p{Lu}[\p{Ll}\p{M}]++)*+"
_FURTHER = rf"\s(?:(?:van|von|der|den|de|del|di|da|la|le|bin|al|el)\s){{0,2}}{_NAME}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_END = r"(?![\p{L}\p{N}])"
_PERSONS = (
    rf"{_TITLE}{_NAME}(?:{_FURTHER}){{0,2}}",
    rf"(?:{MALE_NAMES}|{FEMALE_NAMES})(?:-{_NAME})?(?:{_FURTHER}){{1,2}}",
    rf"(?:{FAMILY_FIRST})\s{_NAME}",
)
_OTHERS = (
    rf"{BORN}(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}})(?!\d)",
    rf"{_LABEL}(?=[A-Za-z+/_\-]*\d)[A-Za-z0-9+/_\-]{{4,}}+",
    r"eyJ[A-Za-z0-9_\-]{6,}+\.[A-Za-z0-9_\-]{6,}+(?:\.[A-Za-z0-9_\-]{6,}+)?",
    rf"{_BEGINNING}[A-Za-z0-9]{{16,}}+",
    r"(?<![\p{M}._%+\-])[\p{L}\p{M}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++",
    r"(?<!\+)\+1 ?\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    r"(?<!\+)(?:\+|00(?=[1-9]))\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)",
    r"(?<!\+)\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    rf"(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    rf"(?<![.\-])(?:\d{{13,19}}|\d{{4}}[ \-]\d{{4}}[ \-]\d{{4}}[ \-]\d{{1,7}}|\d{{3}}-\d{{2}}-\d{{4}}|\d{{3}}[\-. ]\d{{3}}[\-. ]\d{{4}}){_END}",
    rf"(?<![.\-])0[1-9]\d{{1,3}}[ /\-]\d{{3,4}}[ \-]?\d{{3,5}}{_END}",
    rf"(?=[a-f]*\d)[0-9a-f]{{32,64}}{_END}",
    rf"(?=[A-F]*\d)[0-9A-F]{{32,64}}{_END}",
    rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
)
#: No entity begins within a word; testing that, and for persons a capital, once is much cheaper than in each pattern.
PERSON = r"(?=\p{Lu})(?<![\p{L}\p{N}])(?:" + "|".join(_PERSONS) + ")"
ENTITY = r"(?<![\p{L}\p{N}])(?:" + "|".join((*_OTHERS, r"(?=\p{Lu})(?:" + "|".join(_PERSONS) + ")")) + ")"
#: Without any of this a text has no entity but persons.
TRIGGER = r"[0-9@]|gh[pousr]_|sk-|AKIA|ASIA|eyJ"
IS_PERSON = rf"^(?:{_TITLE}\p{{Lu}}|(?:{MALE_NAMES}|{FEMALE_NAMES}|{FAMILY_FIRST})(?:-{_NAME})?\s)"
KINDS = ("mail", "domain", "phone", "card", "number", "iban", "address", "secret", "date", "given", "family")
#: Kinds whose surrogates are hashes.
HASHED = ("mail", "domain", "given", "family")
#: Characters that a secret's places are permuted among.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")
#: The first 16 bits of private addresses, and how many such there are from each on; public ones are numbered without them.
PRIVATE = ((2560, 256), (32512, 256), (44048, 16), (49320, 1))
PUBLIC = 65536 - sum(n for _, n in PRIVATE)
#: Days that dates of birth are permuted among, as a product of two numbers, and the first of them.
DAYS, FIRST_DAY = (17, 4297), "1900-01-01"
DAY_PATTERNS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).cast("long"), F.lit(0).cast("long"))


class Surrogates:
    """Column expressions from an entity to its surrogate; ``variant`` has a number for each of KINDS."""

    def __init__(self, key: str, variant: dict[str, int]):
        if not key:
            raise ValueError("surrogates need a key")
        self.key, self.variant = key, variant

    def _hex(self, kind: str, *what: Column | str) -> Column:
        """64 keyed hexadecimal digits of ``what``."""
        known = F.lit(f"{self.key}|{kind}|{self.variant[kind]}|")
        return F.sha2(F.concat(known, F.concat_ws("|", *[F.lit(w) if isinstance(w, str) else w for w in what])), 256)

    def _number(self, kind: str, *what: Column | str) -> Column:
        return F.conv(F.substring(self._hex(kind, *what), 1, 15), 16, 10).cast("long")

    def _feistel(self, kind: str, left: Column, right: Column, low: Column, high: Column) -> Column:
        """The pair (left mod low, right mod high) permuted, none to itself; ``high`` is 2 or more."""
        def added(side: Column, other: Column, n: int, size: Column, sign: int) -> Column:
            return F.pmod(side + sign * F.pmod(self._number(kind, str(n), other.cast("string")), size), size)

        def turn(n: int, sign: int):
            def left_round(p: Column) -> Column:
                return F.struct(added(p["l"], p["r"], n, low, sign).alias("l"), p["r"].alias("r"))

            def right_round(p: Column) -> Column:
                return F.struct(p["l"].alias("l"), added(p["r"], p["l"], n, high, sign).alias("r"))

            return right_round if n % 2 else left_round

        pair = F.struct(left.alias("l"), right.alias("r"))
        for n in range(ROUNDS):
            pair = _let(pair, turn(n, 1))
        pair = _let(pair, lambda p: F.struct(p["l"].alias("l"), F.pmod(p["r"] + 1, high).alias("r")))
        for n in reversed(range(ROUNDS)):
            pair = _let(pair, turn(n, -1))
        return pair

    def _classed(self, kind: str, value: Column) -> Column:
        """Another string with the same classes at its places, permuted among all such; itself without any of them."""
        every = "".join(CLASSES)

        def moved(code: Column, by: Column | int) -> Column:
            """A character's place in ``every`` from 1 on, moved on within its class; 0, another sign, stays."""
            out, low = F.when(code == 0, code), 0
            for letters in CLASSES:
                out = out.when(code <= low + len(letters), F.pmod(code - low - 1 + by, F.lit(len(letters))) + low + 1)
                low += len(letters)
            return out

        def turn(n: int, sign: int):
            def added(side: Column, other: Column) -> Column:
                def with_stream(stream: Column) -> Column:
                    byte = lambda k: F.conv(F.substr(stream, F.pmod(k, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
                    return F.transform(side, lambda code, k: moved(code, sign * byte(k)))

                return _let(self._hex(kind, str(n), F.array_join(other.cast("array<string>"), ",")), with_stream)

            def left_round(p: Column) -> Column:
                return F.struct(added(p["l"], p["r"]).alias("l"), p["r"].alias("r"))

            def right_round(p: Column) -> Column:
                return F.struct(p["l"].alias("l"), added(p["r"], p["l"]).alias("r"))

            return right_round if n % 2 else left_round

        def whole(codes: Column) -> Column:
            half = F.floor(F.size(codes) / 2).cast("int")
            pair = F.struct(F.slice(codes, F.lit(1), half).alias("l"), F.slice(codes, half + 1, F.size(codes)).alias("r"))
            for n in range(ROUNDS):
                pair = _let(pair, turn(n, 1))
            pair = _let(pair, lambda p: F.struct(*[F.transform(p[x], lambda code: moved(code, 1)).alias(x) for x in "lr"]))
            for n in reversed(range(ROUNDS)):
                pair = _let(pair, turn(n, -1))
            sign = lambda code, k: F.when(code > 0, F.substr(F.lit(every), code, F.lit(1))).otherwise(F.substr(value, k + 1, F.lit(1)))
            return _let(pair, lambda p: F.array_join(F.transform(F.concat(p["l"], p["r"]), sign), ""))

        codes = F.transform(F.sequence(F.lit(1), F.length(value)), lambda k: F.instr(F.lit(every), F.substr(value, k, F.lit(1))))
        return F.when(F.length(value) > 0, _let(codes, whole)).otherwise(value)

    def _within(self, kind: str, value: Column, low: int, high: int) -> Column:
        """A number below ``low * high`` permuted among those."""
        size = [F.lit(n).cast("long") for n in (low, high)]
        pair = self._feistel(kind, F.floor(value / high).cast("long"), F.pmod(value, size[1]), *size)
        return _let(pair, lambda p: p["l"] * high + p["r"])

    def _digits(self, kind: str, digits: Column) -> Column:
        """As many other digits: a permutation of the strings of a length up to 34."""
        half = F.floor(F.length(digits) / 2).cast("int")
        rest = (F.length(digits) - half).cast("int")

        def power(n: Column) -> Column:
            return F.rpad(F.lit("1"), n + 1, "0").cast("long")

        pair = self._feistel(kind, _long(F.substr(digits, F.lit(1), half)), _long(F.substr(digits, half + 1, rest)), power(half), power(rest))
        return _let(pair, lambda p: F.concat(
            F.when(half > 0, F.lpad(p["l"].cast("string"), half, "0")).otherwise(""), F.lpad(p["r"].cast("string"), rest, "0")
        ))

    @staticmethod
    def _luhn(digits: Column) -> Column:
        """The check digit that makes ``digits`` right."""
        places = F.sequence(F.lit(1), F.length(digits))

        def add(total: Column, k: Column) -> Column:
            d = F.substr(F.reverse(digits), k, F.lit(1)).cast("int")
            twice = d * 2 - F.when(d > 4, 9).otherwise(0)
            return total + F.when(k % 2 == 1, twice).otherwise(d)

        return _let(F.aggregate(places, F.lit(0), add), lambda s: F.pmod(-s, F.lit(10)))

    @staticmethod
    def _refilled(shape: Column, digits: Column, keep: Column | None = None) -> Column:
        """``shape`` with its digits after the first ``keep`` replaced by ``digits``, one after another."""
        places = F.sequence(F.lit(1), F.length(shape))
        keep = F.lit(0) if keep is None else keep

        def one(k: Column) -> Column:
            here = F.substr(shape, k, F.lit(1))
            nth = F.length(F.regexp_replace(F.substr(shape, F.lit(1), k), r"\D", "")) - keep
            return F.when(here.rlike(r"\d") & (nth > 0), F.substr(digits, nth, F.lit(1))).otherwise(here)

        return F.array_join(F.transform(places, one), "")

    @staticmethod
    def _spaced(shape: Column, signs: Column) -> Column:
        """``signs`` with the blanks of ``shape``."""
        def one(k: Column) -> Column:
            before = F.replace(F.substr(shape, F.lit(1), k), F.lit(" "), F.lit(""))
            return F.when(F.substr(shape, k, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substr(signs, F.length(before), F.lit(1)))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")

    # one surrogate for each kind, of the canonical form

    def mail(self, m: Column) -> Column:
        return F.concat(F.lit("u"), F.substring(self._hex("mail", m), 1, 16 + 2 * self.variant["mail"]))

    def domain(self, d: Column) -> Column:
        top = F.regexp_extract(d, r"\.(com|net|org|edu|info)$", 1)
        return F.concat(F.lit("d"), F.substring(self._hex("domain", d), 1, 14 + 2 * self.variant["domain"]), F.lit(".example"), F.when(top != "", F.concat(F.lit("."), top)).otherwise(F.lit(".org")))

    def card(self, digits: Column) -> Column:
        body = F.substr(digits, F.lit(3), (F.length(digits) - 3).cast("int"))
        last, issuer = F.substring(digits, -1, 1).cast("int"), F.substring(digits, 1, 2)
        new = F.concat(issuer, self._digits("card", body))
        return _let(new, lambda n: F.concat(n, F.pmod(self._luhn(n) + last - self._luhn(F.concat(issuer, body)), F.lit(10)).cast("string")))

    def iban(self, compact: Column) -> Column:
        account = F.substr(compact, F.lit(5), F.length(compact))
        digits = F.regexp_replace(account, r"\D", "")

        def remainder(rest: Column, k_text: Column) -> Column:
            value = F.when(k_text.rlike(r"\d"), k_text.cast("int")).otherwise(F.ascii(k_text) - 55)
            return F.pmod(rest * F.when(value > 9, 100).otherwise(10) + value, F.lit(97))

        def right(of: Column) -> Column:
            signs = F.filter(F.split(F.concat(of, F.substring(compact, 1, 2), F.lit("00")), ""), lambda c: c != "")
            return 98 - F.aggregate(signs, F.lit(0), remainder)

        def whole(new: Column) -> Column:
            # as far from the right ones as before, so that a wrong one stays another's
            check = F.pmod(right(new) + F.substring(compact, 3, 2).cast("int") - right(account), F.lit(100))
            return F.concat(F.substring(compact, 1, 2), F.lpad(check.cast("string"), 2, "0"), new)

        new = F.when(digits == "", self._classed("iban", account)).otherwise(self._refilled(account, self._digits("iban", digits)))
        return _let(new, whole)

    def address(self, m: Column) -> Column:
        part = [F.element_at(F.split(m, r"\."), k).cast("long") for k in (1, 2, 3, 4)]
        number = ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3]
        # blocks that stay among themselves: leading bits, how many there are
        blocks = ((10, 8), (127, 8), (0xAC1, 12), (0xC0A8, 16))

        def permuted(n: Column) -> Column:
            lead = F.shiftright(n, 16)
            nth = lead
            for first, count in PRIVATE:
                nth = nth - F.when(lead >= first + count, count).otherwise(0)
            out = _let(self._within("address", nth.cast("long") * 65536 + F.pmod(n, F.lit(65536)), PUBLIC, 65536), self._public)
            for lead, bits in blocks:
                half = 1 << (32 - bits) // 2
                own = F.lit(lead << 32 - bits).cast("long")
                out = F.when(F.shiftright(n, 32 - bits) == lead, own + self._within("address", n - own, half, half)).otherwise(out)
            return out

        dotted = lambda x: F.concat_ws(".", *[F.shiftright(x, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)])
        return _let(_let(number, permuted), dotted)

    @staticmethod
    def _public(nth: Column) -> Column:
        """The address that is the ``nth`` of the public ones."""
        lead = F.shiftright(nth, 16)
        for first, count in PRIVATE:
            lead = lead + F.when(lead >= first, F.lit(count)).otherwise(F.lit(0)).cast("long")
        return lead * 65536 + F.pmod(nth, F.lit(65536))

    def secret(self, value: Column) -> Column:
        """As many characters of the same classes."""
        return self._classed("secret", value)

    def token(self, kind: str, script: str, m: Column) -> Column:
        """A name's stem: syllables of its script, without capitals."""
        consonants, vowels, _ = SCRIPTS[script]
        syllables = 4 + self.variant[kind]
        pairs = F.array(*[F.lit(c + v) for c in consonants for v in vowels])
        digest = self._hex(kind, script, m)
        parts = [
            F.element_at(pairs, (F.conv(F.substring(digest, 1 + 4 * k, 4), 16, 10).cast("int") % (len(consonants) * len(vowels)) + 1).cast("int"))
            for k in range(min(syllables, 15))
        ]
        return F.concat(*parts)

    def name(self, kind: Column, m: Column, title: Column) -> Column:
        """The surrogate of one name, of kind given or family."""
        known = lambda names: m.rlike(rf"^(?:{names})(?:-|$)")
        titled = lambda titles: title.rlike(rf"^(?:{titles})\b")
        gender = (
            F.when(known(MALE_NAMES), 0).when(known(FEMALE_NAMES), 1).when(titled(MALE_TITLES), 0).when(titled(FEMALE_TITLES), 1).otherwise(2)
        )
        script = F.when(m.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(m.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
        out = F.lit(None).cast("string")
        for s, (_, _, endings) in SCRIPTS.items():
            given = F.concat(self.token("given", s, m), F.element_at(F.array(*map(F.lit, endings)), gender + 1))
            out = F.when(script == s, F.when(kind == "given", given).otherwise(self.token("family", s, m))).otherwise(out)
        return F.initcap(out)

    def names(self, m: Column) -> Column:
        """A person's names in order: (text, kind, fake); what stands between them has a null kind and itself as fake."""
        title = F.regexp_extract(m, f"^{_TITLE}", 0)
        rest = F.substr(m, F.length(title) + 1, F.length(m))
        family_first = (title == "") & rest.rlike(rf"^(?:{FAMILY_FIRST})\s")

        def one(pieces: Column):
            def struct(x: Column, k: Column) -> Column:
                last = F.when(family_first, k == 0).otherwise(k == F.size(pieces) - 1)
                kind = F.when(x.rlike(r"^\p{Lu}"), F.when(last, "family").otherwise("given"))
                return _let(kind, lambda kd: F.struct(x.alias("text"), kd.alias("kind"), F.when(kd.isNull(), x).otherwise(self.name(kd, x, title)).alias("fake")))

            return F.transform(pieces, struct)

        return _let(F.split(rest, r"(?<=\s)|(?=\s)"), one)

    @staticmethod
    def _secret_value(m: Column) -> Column:
        """A secret without its label; hexadecimal without small letters in lower case."""
        value = F.regexp_replace(m, SECRET_HEAD, "")
        return F.when(value.rlike("^[0-9A-F]+$"), F.lower(value)).otherwise(value)

    @staticmethod
    def _national(m: Column) -> Column:
        """A telephone's digits after country code and trunk zero."""
        digits = F.regexp_replace(m, r"\D", "")
        international = F.regexp_replace(F.regexp_replace(digits, "^00", ""), CALLING_CODE, "")
        return F.regexp_replace(F.when(m.rlike(r"^(?:\+|00)"), international).otherwise(digits), "^0", "")

    @staticmethod
    def _born(m: Column) -> tuple[Column, Column, Column]:
        """A date of birth as days since FIRST_DAY, null if there is no such day, its pattern, and what stands before it."""
        head = F.regexp_extract(m, f"^{BORN}", 0)
        text = F.substr(m, F.length(head) + 1, F.length(m))
        part = F.split(text, r"\D")
        month_first = text.contains("/") & (F.get(part, F.lit(1)).try_cast("int") > 12)
        iso, american, slashed, dotted = DAY_PATTERNS
        pattern = F.when(text.rlike(r"^\d{4}"), iso).when(month_first, american).when(text.contains("/"), slashed).otherwise(dotted)
        lenient = F.regexp_replace(F.regexp_replace(pattern, "MM", "M"), "dd", "d")
        day = F.try_to_timestamp(text, lenient).cast("date")
        days = F.date_diff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
        return F.when((days >= 0) & (days < DAYS[0] * DAYS[1]), days), pattern, head

    def parts(self, m: Column) -> Column:
        """The entity's parts that have surrogates: an array of (kind, real, fake, group).

        Of one kind and group, different reals must have different fakes.
        """

        def row(kind: str, real: Column, fake: Column, group: Column | str = "") -> Column:
            group = F.lit(group) if isinstance(group, str) else group
            return F.struct(F.lit(kind).alias("kind"), real.alias("real"), fake.alias("fake"), group.alias("group"))

        def sized(kind: str, real: Column, fake: Column) -> Column:
            return F.array(row(kind, real, fake, F.length(real).cast("string")))

        digits, lower = F.regexp_replace(m, r"\D", ""), F.lower(m)
        domain, value, national = F.substring_index(lower, "@", -1), self._secret_value(m), self._national(m)
        compact = F.replace(m, F.lit(" "), F.lit(""))
        day, _, _ = self._born(m)
        none = F.array().cast("array<struct<kind:string,real:string,fake:string,group:string>>")
        named = F.transform(
            F.filter(self.names(m), lambda n: n["kind"].isNotNull()),
            lambda n: F.struct(n["kind"].alias("kind"), n["text"].alias("real"), n["fake"].alias("fake"), F.lit("").alias("group")),
        )
        return (
            F.when(m.rlike(IS_PERSON), named)
            .when(m.rlike(f"^{BORN}"), F.when(day.isNull(), none).otherwise(F.array(row("date", day.cast("string"), self._within("date", day, *DAYS).cast("string")))))
            .when(m.rlike(rf"{SECRET_HEAD}|^[0-9a-fA-F]{{32,64}}$"), sized("secret", value, self.secret(value)))
            .when(m.contains("@"), F.array(row("mail", lower, self.mail(lower)), row("domain", domain, self.domain(domain))))
            .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), F.array(row("address", m, self.address(m))))
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), sized("number", digits, self._digits("number", digits)))
            .when(m.rlike(r"^(?:[+(]|00[1-9]|0[1-9]\d{1,3}[ /\-]|\d{3}[\-. ]\d{3}[\-. ]\d{4}$)"), sized("phone", national, self._digits("phone", national)))
            .when(m.rlike(r"^[A-Z]{2}\d{2}"), sized("iban", compact, self.iban(compact)))
            .otherwise(sized("card", digits, self.card(digits)))
        )

    def replaced(self, m: Column) -> Column:
        """The entity's surrogate, in the entity's own format."""

        def written(p: Column) -> Column:
            fake = [F.element_at(p, k)["fake"] for k in (1, -1)]
            kind = F.element_at(p, 1)["kind"]
            digits = F.regexp_replace(fake[0], r"\D", "")
            kept = F.length(F.regexp_replace(m, r"\D", "")) - F.length(fake[0])
            secret = F.regexp_replace(m, SECRET_HEAD, "")
            _, pattern, head = self._born(m)
            new_day = F.date_add(F.lit(FIRST_DAY).cast("date"), fake[0].cast("int"))
            dated = F.coalesce(*[F.when(pattern == p, F.date_format(new_day, p)) for p in DAY_PATTERNS])
            return (
                F.when(kind == "mail", F.concat(fake[0], F.lit("@"), fake[1]))
                .when(kind == "address", fake[0])
                .when(kind == "date", F.concat(head, dated))
                .when(kind == "secret", F.concat(F.regexp_extract(m, SECRET_HEAD, 0), F.when(secret.rlike("^[0-9]*[A-F][0-9A-F]*$"), F.upper(fake[0])).otherwise(fake[0])))
                .when(kind == "phone", self._refilled(m, fake[0], kept))
                .when(kind == "iban", self._spaced(m, fake[0]))
                .otherwise(self._refilled(m, digits))
            )

        parts = _let(self.parts(m), lambda p: F.when(F.size(p) == 0, m).otherwise(written(p)))
        named = F.concat(F.regexp_extract(m, f"^{_TITLE}", 0), F.array_join(F.transform(self.names(m), lambda n: n["fake"]), ""))
        return F.when(m.rlike(IS_PERSON), named).otherwise(parts)


def _found(text: Column) -> Column:
    """The entities of a text in order; most texts can only have persons, which is seen cheaply."""
    every, persons = (F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (ENTITY, PERSON))
    return F.when(text.rlike(TRIGGER), every).otherwise(persons)


def choose_variants(docs: DataFrame, key: str, text_col: str = "text") -> dict[str, int]:
    """The first variant of each hashed kind under which no two values share a surrogate and none is a real value.

    Looks at all names and mail addresses of ``docs``. A frequent one is counted
    before it is moved, so it costs no more than a rare one. Each variant has
    longer surrogates, so a few do for any corpus. Permuted kinds need none.
    """
    hashed = F.col("m").contains("@") | F.col("m").rlike(IS_PERSON)
    entities = cut(docs.select(F.explode(_found(F.col(text_col).cast("string"))).alias("m")).where(hashed).distinct())
    variant = dict.fromkeys(KINDS, 0)
    while True:
        parts = entities.select(F.explode(Surrogates(key, variant).parts(F.col("m"))).alias("p")).select("p.*")
        parts = cut(parts.where(F.col("kind").isin(*HASHED)).distinct())
        # a name may end in one way or another; its stem is what tells it apart
        shared = parts.groupBy("kind", "group", "fake").agg(F.countDistinct("real").alias("n")).where("n > 1").select("kind")
        sides = parts.select("kind", F.col("fake").alias("v"), F.lit(1).alias("side")).union(parts.select("kind", "real", F.lit(2)))
        foreign = sides.groupBy("kind", "v").agg(F.countDistinct("side").alias("n")).where("n > 1").select("kind")
        bad = shared.union(foreign).distinct().collect()
        if not bad:
            return variant
        for r in bad:
            variant[r["kind"]] += 1


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", variant: dict[str, int] | None = None, count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col``; all else, order of columns included, as it was.

    ``count_col`` names a further column for the number of entities replaced,
    later mentions of persons included. A null text stays null (0 entities), an
    empty one empty. Null ids, repeated rows and other columns, whatever their
    names, stay as they are; an empty table gives an empty one. A very long text
    is rewritten in its row; no pattern's depth grows with it. ``variant``: as
    ``choose_variants`` gives it; by default it is chosen over ``docs``.
    """
    made = Surrogates(key, choose_variants(docs, key, text_col) if variant is None else variant)
    text = F.col(text_col).cast("string")
    (done,) = fresh(docs, "_replaced")

    def rewritten(found: Column) -> Column:
        """(text, number of entities)"""
        persons = F.filter(found, lambda m: m.rlike(IS_PERSON))
        named = F.filter(F.flatten(F.transform(persons, made.names)), lambda n: n["kind"].isNotNull())

        def with_names(names: Column) -> Column:
            alone = F.array_sort(F.array_distinct(F.transform(names, lambda n: n["text"])), lambda a, b: F.length(b) - F.length(a))
            mention = F.concat(F.lit(rf"{ENTITY}|(?<![\p{{L}}\p{{N}}])(?:"), F.array_join(alone, "|"), F.lit(f"){_END}"))
            pattern = F.when(F.size(names) > 0, mention).otherwise(ENTITY)
            again = F.when(F.size(names) > 0, F.regexp_extract_all(text, mention, F.lit(0))).otherwise(found)

            def one(m: Column) -> Column:
                mentioned = F.filter(names, lambda n: n["text"] == m)
                return F.when(F.size(mentioned) > 0, F.get(mentioned, F.lit(0))["fake"]).otherwise(made.replaced(m))

            def joined(new: Column) -> Column:
                put = F.transform(F.split(text, pattern, -1), lambda x, k: F.concat(x, F.coalesce(F.get(new, k), F.lit(""))))
                return F.struct(F.array_join(put, "").alias("text"), F.size(new).alias("n"))

            return _let(F.transform(again, one), joined)

        whole = F.struct(text.alias("text"), F.lit(0).alias("n"))
        return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, _let(named, with_names)).otherwise(whole)

    rows = docs.withColumn(done, _let(_found(text), rewritten))
    rows = rows.withColumn(text_col, F.col(done)["text"])
    if count_col is not None:
        rows = rows.withColumn(count_col, F.col(done)["n"])
    return rows.drop(done)


def configured_key(spark: SparkSession) -> str:
    """The session's key; without one an example key, with a warning: who knows it can find out what surrogates stand for."""
    key = spark.conf.get(KEY_SETTING, "")
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set; surrogates under the example key are not secret", stacklevel=2)
    return key or EXAMPLE_KEY


def op6_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text with surrogates, n_entities) of each document; nulls, repeated rows and long texts as in ``pseudonymise``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, configured_key(spark), count_col="n_entities")
