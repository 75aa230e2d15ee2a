"""PII surrogates in DataFrame functions alone.

Entities (e-mail and IPv4 addresses, telephone, card, social-security and bank-account
numbers, and personal names) are replaced by surrogates of the same type and format.  A
surrogate is the image of the entity under a keyed permutation:

* Two passes over the characters, one from the left and one from the right, shift each
  character within its class (digits; Latin vowels and consonants; Cyrillic and Greek
  letters; the letters of other scripts; ...) by an amount that a keyed hash draws from the
  characters before (after) it.  Either pass can be undone, so distinct entities of one format
  have distinct surrogates, without a table of what was given out.  Case is ignored in the hash
  and kept in the image, and phone and card numbers are permuted by their digits alone, so
  spellings of one entity stay spellings of one surrogate.
* Octets of an IPv4 address are shifted modulo 256; the last digit of a card number and the
  check digits of a bank account carry over whether the checksum holds; a telephone number
  keeps its country code, an e-mail address its top-level domain.
* Listed given names are permuted within the names of the same gender and script.  Others keep
  their last letter, which tells of gender, and never become a listed name (their permutation
  is walked until it leaves the list).  Cyrillic and Greek surnames keep their last three
  letters, and with them the form for a woman or a man.

A name is a listed given name before a surname; one or two capitalised words after a title; two
after a cue (``Dear``, ``Name:``, ``signed by``); two of which the other has the ending of a Russian
or Greek surname.  Initials and particles (``van``) stay.

``checked_key`` looks on the data whether surrogates are distinct where entities are, and one
where entities are spellings of one; it moves on to another key derived from the given one if
not.  The queries take their key from ``spark.logradex.piiKey``; a session without it has a
random one, so surrogates then agree within the session only.

Edge cases: null text stays null; text without entities stays as it is; an entity that
repeats has one surrogate throughout the corpus; nothing else in the text changes; very long
runs and texts are read whole in linear time; repeated rows and null ids give a row each; an empty
table gives an empty result; other columns stay as they are, whatever their names.  A surrogate
can equal its entity by chance (1 in 105 for a surname of two letters).
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEY_SETTING = "spark.logradex.piiKey"
KEYS_TRIED = 8
GIVEN = {
    ("f", "latin"): """Maria Anna Elena Julia Laura Sophie Emily Jennifer Jessica Sarah Elizabeth Margaret Susan Karen
    Nancy Linda Patricia Barbara Michelle Amanda Melissa Stephanie Rebecca Katharina Claudia Monika Sabine Camille
    Isabelle Nathalie Carmen Lucia Beatriz Fernanda Juliana Gabriela Mary Dorothy Helen Sandra Donna Carol Ruth Sharon
    Deborah Cynthia Kathleen Amy Angela Shirley Brenda Pamela Nicole Christine Catherine Alice Jane Emma Olivia Sophia
    Hannah Ursula Ingrid Renate Petra Heike Anja Birgit Gisela Marie Jeanne Monique Sylvie Valerie Chantal Brigitte
    Ana Isabel Pilar Rosa Teresa Cristina Marta Francisca Amira Fatima Aisha Leila Priya Anjali Yuki Mei Olga Svetlana
    Natalia Tatiana Ekaterina Giulia Francesca Chiara Paola""",
    ("m", "latin"): """James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew
    Anthony Steven Andrew Kenneth George Edward Brian Stefan Andreas Wolfgang Juergen Pierre Jacques Antoine Francois
    Carlos Miguel Fernando Antonio Eduardo Rodrigo Marcelo Rafael Paul Donald Ronald Timothy Jason Jeffrey Ryan Jacob
    Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Peter
    Dennis Jerry Tyler Aaron Adam Nathan Henry Douglas Zachary Kyle Walter Arthur Albert Bob Jim Tom Mike Hans Klaus
    Juergen Dieter Helmut Uwe Bernd Matthias Jean Michel Alain Philippe Laurent Luc Marc Juan Pedro Luis Javier Manuel
    Francisco Diego Alejandro Pablo Jorge Mohammed Ahmed Omar Hassan Ali Raj Arjun Hiroshi Kenji Ivan Sergei Dmitri
    Alexei Vladimir Giovanni Marco Luca Giuseppe""",
    ("f", "cyrillic"): """Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Людмила Галина""",
    ("m", "cyrillic"): """Иван Александр Сергей Дмитрий Андрей Алексей Владимир Николай Михаил Павел Юрий Борис""",
    ("f", "greek"): """Ελένη Κατερίνα Αικατερίνη Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα""",
    ("m", "greek"): """Γεώργιος Δημήτρης Κωνσταντίνος Νικόλαος Παναγιώτης Βασίλης Χρήστος Αθανάσιος""",
}
TITLES = """Mr Mrs Ms Miss Mister Dr Prof Professor Herr Frau Monsieur Madame Mme Mlle Señor Señora Señorita Sr Sra Signor Signora
    г-н г-жа господин госпожа κύριος κυρία""".split()
#: Before a name of two words.
CUES = """Dear|dear|Name:|name:|name is|Contact:|contact:|Patient:|Employee:|Author:|Signed,|signed by|written by|Sincerely,|Regards,
    regards,|Attn:|attn:|Cc:|cc:|From:|To:|I am|mein Name ist|je m'appelle|me llamo""".replace("\n    ", "|").split("|")
NO_NAMES = """The This That These Those There Here He She It We They You In On At By But And Or If When While Then Our My His
    Her Their Its Your No Not All Each Both Some Many Most New United North South East West Saint Mount Lake Fort Port Sir
    Madam Team All Customer Support Google Microsoft Apple Reuters""".split()

_DIGIT = "0123456789"
_CLASSES = [
    _DIGIT, "aeiou", "bcdfghjklmnpqrstvwxyz", "àâäáãåèêëéìîïíòôöóõùûüúæœāăąēėęěīįōőūűųůý", "çñšžčřťďňľśźćńłğşđķļņģ", "ß",
    "аеиоуыэюяёіїє", "бвгджзйклмнпрстфхцчшщъьґ", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ",
]
#: Letters of other scripts, as ranges of code points.
_RANGES = [
    (0x05D0, 0x05EA), (0x0627, 0x063A), (0x0641, 0x064A), (0x0905, 0x0939), (0x0E01, 0x0E2E), (0x10D0, 0x10F0), (0x3041, 0x3096),
    (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# possessive groups are loops; Java's matcher recurses over others, so those are bounded
EMAIL = (
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?=[\p{L}\p{N}.-]*?\p{L}{2})"
    r"[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
)
IPV4 = rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
PHONE = (
    r"(?:(?<![0-9A-Za-z])\+(?=(?:[ ().-]{0,2}[0-9]){8})[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}"
    r"(?:[ .-]?[0-9]{2,5}){0,4}|(?<![0-9A-Za-z(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
    r"|(?<![0-9A-Za-z.-])(?:1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])"
)


def _names() -> dict[tuple[str, str], list[str]]:
    return {k: v.split() for k, v in GIVEN.items()}


def _any(words) -> str:
    """One of the words, told apart by their first letters."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        heads.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(h + "(?:" + "|".join(tails) + ")" for h, tails in sorted(heads.items())) + ")"


_END = r"(?![\p{L}\p{N}])"
_WORD = r"\p{Lu}(?:['’]\p{Lu})?+\p{Ll}++(?:[-'’]?\p{Lu}\p{Ll}++)?+"
_MIDDLE = r"(?: \p{Lu}\.)?+"
_SURNAME = r" (?:(?:van|von|der|den|de|del|della|di|da|dos|la|le|el|al|bin|ibn|ter|ten) )*+" + _WORD
_NO_NAME = "(?!" + _any(NO_NAMES) + _END + ")"
_RUSSIAN = r"(?:ов|ова|ев|ева|ёв|ёва|ин|ина|ын|ына|ский|ская|цкий|цкая|енко|чук|щук|ович|евич)"
_GREEK = r"(?:όπουλος|οπούλου|ίδης|ίδου|άδης|άδου|άκης|άκη|άτος|ίου|έας)"
_PATRONYMIC = r"(?: [А-ЯЁ][а-яё]+(?:вич|вна|ична))?+"
NAME = (
    r"(?<![\p{L}\p{N}])(?=\p{Lu})(?:"
    + "|".join([
        _any(n for v in _names().values() for n in v) + _END + _MIDDLE + _SURNAME + _END,
        rf"(?<=(?<![\p{{L}}\p{{N}}])(?:{'|'.join(TITLES)})\.? ){_WORD}(?:{_MIDDLE}{_SURNAME})?+{_END}",
        rf"(?<=(?<![\p{{L}}\p{{N}}])(?:{'|'.join(CUES)})[ \n]){_NO_NAME}{_WORD}{_MIDDLE}{_SURNAME}{_END}",
        rf"[А-ЯЁ][а-яё]+{_PATRONYMIC} [А-ЯЁ][а-яё]+(?<={_RUSSIAN}){_END}",
        rf"[Α-ΩΆ-Ώ][α-ωά-ώ]+ [Α-ΩΆ-Ώ][α-ωά-ώ]+(?<={_GREEK}){_END}",
    ])
    + ")"
)
#: In this order, the first that fits at a place is taken.
ENTITY = "|".join(f"(?:{p})" for p in (EMAIL, IPV4, SSN, IBAN, CARD, PHONE, NAME))


def _keyed(key: str, salt: Column, *parts: Column) -> Column:
    """60 bits of a keyed hash, as a bigint."""
    text = F.concat_ws("\x1f", F.lit(key), salt, *parts)
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def _shift(c: Column, amount: Column) -> Column:
    """Move a character on within its class, keeping case; others stay."""
    low = F.lower(c)
    out = c
    for cls in _CLASSES:
        at = F.instr(F.lit(cls), low)  # 1-based
        new = F.substring(F.lit(cls), (F.pmod(at - 1 + amount, F.lit(len(cls))) + 1).cast("int"), F.lit(1))
        hit = at > 0
        if cls != _DIGIT:
            new = F.when(c == low, new).otherwise(F.upper(new))
            if "ß" in cls:  # its capital is no single letter
                hit = hit & (c == low) if cls == "ß" else hit
        out = F.when(hit, new).otherwise(out)
    other = c
    for low_, high in _RANGES:
        code = F.lit(low_) + F.pmod(F.ascii(c) - low_ + amount, F.lit(high - low_ + 1))
        new = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        other = F.when(c.between(chr(low_), chr(high)), new).otherwise(other)
    return F.when(c > "\u052f", other).otherwise(out)


def _chars(v: Column) -> Column:
    return F.regexp_extract_all(v, F.lit("(?s)(.)"), F.lit(1))


def permute(v: Column, key: str, salt: Column) -> Column:
    """The keyed permutation of strings of one format."""

    def side(s: Column, way: str, seen: Callable[[Column], Column]) -> Column:
        size, salted = F.length(s).cast("string"), F.concat(salt, F.lit(way))
        return F.array_join(F.transform(_chars(s), lambda c, i: _shift(c, _keyed(key, salted, F.lower(seen(i)), size))), "")

    def forward(s: Column) -> Column:
        return side(s, ">", lambda i: F.substring(s, F.lit(1), i))

    def backward(s: Column) -> Column:
        return side(s, "<", lambda i: F.substring(s, i + 2, F.length(s)))

    return _bound(_bound(v, forward), backward)


def _bound(v: Column, f: Callable[[Column], Column]) -> Column:
    """f(v) with v evaluated once."""
    return F.element_at(F.transform(F.array(v), lambda x: f(x)), 1)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _fill(v: Column, digits: Column) -> Column:
    """v with its digits, in order, replaced."""
    return _bound(
        F.struct(v.alias("v"), digits.alias("d")),
        lambda x: F.array_join(
            F.transform(
                _chars(x["v"]),
                lambda c, i: F.when(
                    c.between("0", "9"), F.substring(x["d"], F.length(_digits(F.substring(x["v"], F.lit(1), i + 1))), F.lit(1))
                ).otherwise(c),
            ),
            "",
        ),
    )


def _luhn(body: Column) -> Column:
    """Check digit for the digits of a body."""
    return _bound(
        body,
        lambda b: F.pmod(
            -F.aggregate(
                F.sequence(F.lit(1), F.length(b)),
                F.lit(0),
                lambda acc, i: acc + _double(F.substring(b, -i, F.lit(1)).cast("int"), i % 2 == 1),
            ),
            F.lit(10),
        ),
    )


def _double(d: Column, twice: Column) -> Column:
    return F.when(~twice, d).when(d >= 5, 2 * d - 9).otherwise(2 * d)


def _card(v: Column, inner: Column) -> Column:
    """The first digit stays, the checksum holds where it did."""

    def image(d: Column) -> Column:
        off = F.pmod(F.substring(d, -1, 1).cast("int") - _luhn(F.substring(d, F.lit(1), F.length(d) - 1)), F.lit(10))
        return _bound(
            F.concat(F.substring(d, 1, 1), inner),
            lambda b: F.concat(b, F.pmod(_luhn(b) + off, F.lit(10)).cast("string")),
        )

    return _fill(v, _bound(_digits(v), image))


def _code(v: Column) -> Column:
    """How many digits of a telephone number are its country code, whatever stands between them."""
    d = _digits(v)
    two = "^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
    return (
        F.when(v.startswith("+"), F.when(d.rlike("^[17]"), 1).when(d.rlike(two), 2).otherwise(3))
        .when((F.length(d) == 11) & d.startswith("1"), 1)
        .otherwise(0)
    )


def _ends(v: Column) -> Column:
    """How many of a surname's last letters stay: those of a Cyrillic or Greek one tell of gender."""
    return F.when(v.rlike(r"[\p{IsCyrillic}\p{IsGreek}]$"), F.least(F.lit(3), F.length(v) - 1)).otherwise(0)


def _bodies(v: Column) -> Column:
    """What of an entity is permuted, and under which salt: up to two strings."""

    def of(*parts: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(salt).alias("salt"), part.alias("part")) for salt, part in parts])

    d = _digits(v)
    host = F.substring_index(v, "@", -1)
    flat = F.translate(v, " ", "")
    first, last = F.substring_index(v, " ", 1), F.substring_index(v, " ", -1)
    given = F.when(first == v, F.lit("")).otherwise(F.substring(first, F.lit(1), F.length(first) - 1))
    return _by_kind(
        v,
        email=of(
            ("local", F.substring_index(v, "@", 1)),
            ("domain", F.substring(host, F.lit(1), F.length(host) - F.length(F.substring_index(host, ".", -1)) - 1)),
        ),
        ipv4=of(("ip", F.lit(""))),
        ssn=of(("ssn", d)),
        iban=of(("iban", F.substring(flat, F.lit(5), F.length(flat)))),
        card=of(("card", F.substring(d, F.lit(2), F.length(d) - 2))),
        phone=of(("phone", F.substring(d, _code(v) + 1, F.length(d)))),
        name=of(("surname", F.substring(last, F.lit(1), F.length(last) - _ends(last))), ("given", given)),
    )


def _ipv4(v: Column, key: str) -> Column:
    def run(s: Column, forward: bool) -> Column:
        parts = F.split(s, "\\.")
        seen = (lambda p, i: F.slice(p, F.lit(1), i)) if forward else (lambda p, i: F.slice(p, i + 2, F.lit(4)))
        return F.array_join(
            F.transform(
                parts,
                lambda o, i: F.pmod(
                    o.cast("bigint") + _keyed(key, F.lit(f"ip{forward}"), F.array_join(seen(parts, i), "."), i.cast("string")),
                    F.lit(256),
                ).cast("string"),
            ),
            ".",
        )

    return _bound(_bound(v, lambda s: run(s, True)), lambda s: run(s, False))


def _given(key: str) -> dict[str, str]:
    """The keyed permutation of given names, within gender and script, without fixed points."""
    out = {}
    for group, names in _names().items():
        order = sorted(names, key=lambda n: hashlib.sha256("\x1f".join((key, *group, n)).encode()).digest())
        out |= {a: b for a, b in zip(order, order[1:] + order[:1])}
    return out


def _name(v: Column, key: str, surname: Column, stem: Column) -> Column:
    """With the permuted stems of the surname and of a given name that isn't listed."""
    # one literal; spelled out, each use would weigh on the planner
    table = F.str_to_map(F.lit(",".join(f"{a}:{b}" for a, b in sorted(_given(key).items()))), F.lit(","), F.lit(":"))
    first, last = F.substring_index(v, " ", 1), F.substring_index(v, " ", -1)
    between = F.substring(v, F.length(first) + 1, F.length(v) - F.length(first) - F.length(last))

    def again(x: Column) -> Column:
        return F.concat(permute(F.substring(x, F.lit(1), F.length(x) - 1), key, F.lit("given")), F.substring(x, -1, 1))

    # a permutation of the names outside the list: on, as long as it leads into the list
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(8)), F.concat(stem, F.substring(first, -1, 1)),
        lambda x, _: F.when(F.map_contains_key(table, x), again(x)).otherwise(x),
    )
    given = F.coalesce(F.try_element_at(table, first), walked)
    tail = F.concat(surname, F.substring(last, F.length(last) - _ends(last) + 1, F.length(last)))
    return F.when(first == v, tail).otherwise(F.concat(given, between, tail))


def _iban(v: Column, account: Column) -> Column:
    """With another account: the country stays; the check digits hold where they did."""

    def valid(x: Column) -> Column:
        """Check digits for a country and an account, run together."""
        digits = F.concat(F.substring(x, F.lit(3), F.length(x)), F.substring(x, 1, 2), F.lit("00"))
        at = F.instr
        rest = F.aggregate(
            _chars(digits),
            F.lit(0).cast("bigint"),
            lambda acc, c: F.when(c.between("0", "9"), acc * 10 + c.cast("bigint"))
            .otherwise(acc * 100 + 9 + at(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c)) % 97,
        )
        return 98 - rest

    def image(flat: Column) -> Column:
        land, check, old = F.substring(flat, 1, 2), F.substring(flat, 3, 2), F.substring(flat, F.lit(5), F.length(flat))
        off = F.pmod(check.cast("bigint") - valid(F.concat(land, old)), F.lit(100))
        new = F.pmod(valid(F.concat(land, account)) + off, F.lit(100)).cast("string")
        return F.concat(land, F.lpad(new, 2, "0"), account)

    return _bound(
        F.struct(v.alias("v"), _bound(F.translate(v, " ", ""), image).alias("new")),
        lambda x: F.array_join(
            F.transform(
                _chars(x["v"]),
                lambda c, i: F.when(c == " ", c).otherwise(
                    F.substring(x["new"], F.length(F.translate(F.substring(x["v"], F.lit(1), i + 1), " ", "")), F.lit(1))
                ),
            ),
            "",
        ),
    )


def _by_kind(v: Column, **of: Column) -> Column:
    """One of the columns email, ipv4, ssn, iban, card, phone and name, by what the entity v is."""
    return (
        F.when(v.contains("@"), of["email"])
        .when(v.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), of["ipv4"])
        .when(v.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), of["ssn"])
        .when(v.rlike("^[A-Z]{2}[0-9]{2}"), of["iban"])
        .when(v.rlike("^[0-9]") & (F.length(_digits(v)) >= 13), of["card"])
        .when(v.rlike("^[+(0-9]"), of["phone"])
        .otherwise(of["name"])
    )


def surrogate(v: Column, key: str) -> Column:
    """The surrogate of an entity that ``ENTITY`` found."""

    def of(x: Column) -> Column:
        e, new = x["e"], x["new"]
        one, two = F.get(new, F.lit(0)), F.get(new, F.lit(1))
        return _by_kind(
            e,
            email=F.concat(one, F.lit("@"), two, F.lit("."), F.substring_index(e, ".", -1)),
            ipv4=_ipv4(e, key),
            ssn=_fill(e, one),
            iban=_iban(e, one),
            card=_card(e, one),
            phone=_fill(e, F.concat(F.substring(_digits(e), F.lit(1), _code(e)), one)),
            name=_name(e, key, one, two),
        )

    images = F.transform(_bodies(v), lambda b: permute(b["part"], key, b["salt"]))
    return _bound(F.struct(v.alias("e"), images.alias("new")), of)


def entities(text: Column) -> Column:
    """The entities of a text, in order (empty array if none)."""
    some = text.contains("@") | text.rlike("[0-9]") | text.rlike(NAME)
    return F.when(some, F.regexp_extract_all(text, F.lit(f"({ENTITY})"), F.lit(1))).otherwise(
        F.array().cast("array<string>")
    )


def replaced(text: Column, found: Column, key: str) -> Column:
    """The text with its entities replaced."""
    between = F.split(text, ENTITY, -1)
    whole = F.zip_with(between, F.transform(found, lambda v: surrogate(v, key)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(whole, "")).otherwise(text)


def with_surrogates(docs: DataFrame, *, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """All columns, with entities in ``text_col`` replaced; ``count_col`` adds how many."""
    found = common.free_name(docs, "entities_found")
    text = F.col(f"`{text_col}`")
    out = docs.withColumn(found, entities(text))
    # kept apart, so that the search isn't repeated for each use of its result
    out = out.withColumn(text_col, replaced(text, F.col(found), key))
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.size(found), F.lit(0)).cast("bigint"))
    return out.drop(found)


def collisions(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """Surrogates that stand for more than one entity, spellings aside, and entities with more than one: empty if
    distinctness and coreference hold."""
    v = F.col("entity")

    def spelled(x: Column) -> Column:
        """One form for all spellings, under the kind of v."""
        phone = F.concat(F.lit("phone "), _code(x).cast("string"), F.lit(" "), _digits(x))
        return _by_kind(
            v, email=F.concat(F.lit("email "), F.lower(x)), ipv4=F.concat(F.lit("ipv4 "), x), ssn=F.concat(F.lit("ssn "), x),
            iban=F.concat(F.lit("iban "), F.translate(x, " ", "")), card=F.concat(F.lit("card "), _digits(x)), phone=phone,
            name=F.concat(F.lit("name "), x),
        )

    seen = docs.select(F.explode(entities(F.col(f"`{text_col}`"))).alias("entity")).distinct()
    pairs = seen.select(v, surrogate(v, key).alias("surrogate")).select(
        spelled(v).alias("entity"), spelled(F.col("surrogate")).alias("surrogate")
    ).distinct()
    ways = F.explode(F.array(F.struct(F.lit("entity").alias("kind"), F.col("entity").alias("value")),
                             F.struct(F.lit("surrogate").alias("kind"), F.col("surrogate").alias("value"))))
    sides = pairs.select(ways.alias("side")).select("side.*")
    return sides.groupBy("kind", "value").agg(F.count("*").alias("n")).where("n > 1")


def checked_key(docs: DataFrame, key: str, *, text_col: str = "text") -> str:
    """The first of the keys derived from ``key`` (itself first) under which nothing collides in these documents."""
    for n in range(KEYS_TRIED):
        one = key if not n else f"{key}\x1e{n}"
        if collisions(docs, key=one, text_col=text_col).isEmpty():
            return one
    raise ValueError(f"surrogates collide under {KEYS_TRIED} keys")


_SESSION_KEYS: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting, or else a random one for the application."""
    drawn = _SESSION_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING, None) or drawn


def op10(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs, key=checked_key(docs, session_key(spark)), count_col="n_entities")
