"""Operator 6: personal data replaced by surrogates, in built-in functions only.

One pattern finds e-mail addresses, IPv4 addresses, telephone numbers, social-security numbers, payment-card numbers,
secrets (long hexadecimal strings and common key formats) and names after a title. A text is cut at the matches, each
match is replaced by an expression of itself and a key, and the pieces are joined again; what is not matched stays as
it was, byte for byte.

A name is any number of capitalised words, initials and particles after one or more titles, in one line; the family
name of such a name is replaced in the whole text, also without a title, with known given names before it.
Telephone numbers have a '+', or are North American (ten digits, or eleven with a 1, with or without separators). Cards
have 13 to 19 digits. Not found: names that have no title anywhere in the text, given names alone, names in scripts
without capitals, national numbers of other countries, and local numbers of seven digits.

Surrogates keep type and format:

- digits of telephone, card and social-security numbers go through a keyed Feistel network over their decimal digits,
  so that distinct numbers stay distinct; separators, a telephone's country code and the validity of a card's check
  digit are kept. IPv4 addresses go through one over 2 x 16 bits;
- e-mail addresses get a keyed local part of letters, at a reserved domain; names get given names of the title's
  gender and a keyed family name, in Latin, Cyrillic or Greek letters as the original (other scripts: Latin); secrets
  keep their prefix, length and marks, and each digit, capital and small letter gets a keyed one of its kind (in
  hexadecimal strings a hexadecimal one);
- the same entity (addresses and names regardless of case) has the same surrogate everywhere: coreference holds within
  and between texts. Case follows the original (secrets that differ in case are different ones). A family name is keyed by the last word of a name and the title's gender
  (Mr Smith and Mrs Smith are different entities), a given name by its word and that gender. Dr, Prof and mentions
  without a title take the gender of a name in the same text, and else none: between texts, Dr Lee and Frau Lee are
  coreferent only if each text has a title that tells the gender.

An unbroken run of 13 or 14 digits is a card only if its check digit is right; others (times, for instance) stay.

Collision check: all distinct entities of the corpus are compared with their surrogates (a name once for each gender it
occurs with, and its family name alone). Of entities that share a surrogate the first keeps it; the others, and those
whose surrogate is an entity of the corpus, are tried again with another key, one by one, until none collide. The tries
go to the texts that need them by a join; no other entity's surrogate changes.

Null texts stay null, empty ones empty. Texts of any length are searched whole. Repeated rows get equal results. All
other columns are kept. A surrogate looks like its type, so that a second run replaces it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import text_print
from .rules import let

#: Texts up to which a table of tries is broadcast; beyond, the join is a shuffle.
BROADCAST_TEXTS = 100_000

#: Country codes of telephone numbers, of one, two or three digits.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})"
#: Letters of an address, syllables of a family name, and of a given name that is tried again.
ADDRESS, FAMILY, GIVEN = 16, 5, 2
#: Tries of one entity, at most.
TRIES = 60
#: Default key. Give another for each corpus whose surrogates must not be linkable.
KEY = "isopleth"
MALE = "James John Robert Michael David William Thomas Daniel Paul Mark George Peter Henry Frank Simon Oliver".split()
FEMALE = "Mary Linda Susan Karen Nancy Lisa Sarah Anna Emma Laura Julia Alice Helen Clara Diana Sophie".split()
NEUTRAL = "Alex Robin Kim Sasha Jordan Taylor Casey Morgan Jamie Avery Riley Quinn Dana Kerry Leslie Drew".split()
CYRILLIC = {
    "m": "Иван Пётр Павел Олег Игорь Антон Денис Роман Фёдор Юрий Глеб Борис Максим Виктор Андрей Сергей".split(),
    "f": "Анна Мария Ольга Ирина Елена Нина Вера Юлия Дарья Софья Лидия Алина Раиса Тамара Полина Галина".split(),
    "n": "Саша Женя Валя Слава Шура Паша Тоня Стася Миша Лёка Ника Вася Гриня Лёля Тося Саня".split(),
}
GREEK = {
    "m": "Γιώργος Νίκος Κώστας Γιάννης Πέτρος Παύλος Ανδρέας Μάρκος Λουκάς Στέφανος Θωμάς Ηλίας Σπύρος Λεωνίδας Μιχάλης Φώτης".split(),
    "f": "Μαρία Ελένη Άννα Σοφία Κατερίνα Ειρήνη Δήμητρα Βασιλική Ζωή Χριστίνα Ιωάννα Δέσποινα Αγγελική Φωτεινή Όλγα Λυδία".split(),
}
GREEK["n"] = GREEK["m"] + GREEK["f"]
#: Scripts beside Latin: a pattern, given names, the letters of syllables (for abdefghiklmnoprst) and of addresses (for a-p), the alphabet of initials.
SCRIPTS = (
    (r"\p{IsCyrillic}", CYRILLIC, "абдефгхиклмнопрст", "абвгдежзиклмнопр", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"),
    (r"\p{IsGreek}", GREEK, "αβδεφγχικλμνοπρστ", "αβγδεζηθικλμνξοπ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
)
SYLLABLES = "ba be bi bo da de di do fa fe ga go ha ka ke ko la le li lo ma me mi mo na ne no pa ra re sa ta".split()

_TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora"), "n": ("Dr", "Prof")}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ANY_TITLE = "(?:" + "|".join(x for some in _TITLES.values() for t in some for x in (t, t.upper())) + ")"
_SPACE = r"[ \t\u00a0]+"
_PARTICLES = "van von vom der den dem de del della di da das do dos du la le zu zum zur ten ter af av al el bin ibn ben".split()
# a word of two letters or more, without the possessive; suffixes are none; no loop over a group may go back, as Java's stack is short
_WORD = r"(?!(?:Jr|JR|Sr|SR|II|III|IV)(?!\p{L}))\p{Lu}(?:[\p{L}\p{M}]|(?!['’][sS](?!\p{L}))['’-]\p{L})++"
_BEFORE = rf"(?:\p{{Lu}}\.-?[ \t\u00a0]*|\p{{Lu}}{_SPACE}|(?:{'|'.join(_PARTICLES)}){_SPACE}|[dl]['’](?=\p{{Lu}}))*+"
_TITLED = rf"{_ANY_TITLE}\.?(?:{_SPACE}|\r?\n[ \t]*)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}][\p{L}\p{N}-]{0,62}\.){1,126}\p{L}{2,}",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|sk-(?:[a-z]{2,8}\d{0,2}-)?[0-9A-Za-z_-]{20,})(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])(?:(?<![\d.-])1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])(?:1[ .-])?(?:\d{3}[.-]\d{3}[.-]|[2-9]\d{2} \d{3}[ .-])\d{4}(?![\d-])|(?<![\d.-])1?[2-9]\d{9}(?![\d-]|\.\d)",
    "card": r"(?<![\p{L}\d.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19})(?![\d-])",
    # no start within a run of titles, which would be read again from each of them
    "name": rf"(?<!\p{{L}})(?={_ANY_TITLE})(?<!{_ANY_TITLE}\.?[ \t\u00a0\r\n]{{1,16}})(?:{_TITLED})++(?:{_BEFORE}{_WORD}(?:{_SPACE}{_BEFORE}{_WORD})*+|(?:\p{{Lu}}\.)++|\p{{Lu}}(?![\p{{L}}\p{{M}}'’-]))",
}
PATTERN = "|".join(PATTERNS.values())
# matches without a digit or an '@': names, and secrets of letters
_HINT = rf"{_TITLED}[\p{{Lu}}\p{{Ll}}]|AKIA[A-Z]|gh[pousr]_|sk-[A-Za-z]|[a-f]{{32}}|[A-F]{{32}}"


def _hash(key, *parts) -> Column:
    """Non-negative keyed 60-bit number."""
    text = F.concat_ws("\x1f", F.lit(key), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _feistel(key, left: Column, right: Column, left_size: Column, right_size: Column, tag: Column) -> Column:
    """A keyed permutation of pairs below the sizes: struct(l, r)."""
    state = F.struct(left.alias("l"), right.alias("r"))
    for turn in range(6):
        if turn % 2:
            step = lambda s, t=turn: F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(_hash(key, t, tag, s["l"]), right_size), right_size).alias("r"))
        else:
            step = lambda s, t=turn: F.struct(F.pmod(s["l"] + F.pmod(_hash(key, t, tag, s["r"]), left_size), left_size).alias("l"), s["r"].alias("r"))
        state = let(state, step)
    return state


def _permuted_digits(key, digits: Column, tag: str) -> Column:
    """A string of 2 to 36 decimal digits to one of the same length, one-to-one."""

    def of(d):
        half = F.floor(F.length(d) / 2).cast("int")
        ten = lambda n: F.pow(F.lit(10.0), n).cast("long")
        whole = F.concat(F.lit(tag), F.length(d).cast("string"))
        state = _feistel(key, F.substring(d, F.lit(1), half).cast("long"), d.substr(half + 1, F.length(d)).cast("long"), ten(half), ten(F.length(d) - half), whole)
        return let(state, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), F.length(d) - half, "0")))

    return let(digits, of)


def _luhn_digit(digits: Column) -> Column:
    """The check digit of a string of digits."""
    from_right = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(from_right, F.lit(0), lambda a, b: a + b), F.lit(10))


def _into(original: Column, digits: Column) -> Column:
    """The original with its digits replaced in order."""
    before = lambda i: F.length(F.regexp_replace(F.substring(original, F.lit(1), i + 1), r"\D", ""))
    return F.array_join(F.transform(F.split(original, ""), lambda c, i: F.when(c.rlike(r"^\d$"), digits.substr(before(i), F.lit(1))).otherwise(c)), "")


def _letters(key, tag: str, entity: Column, width: int) -> Column:
    """`width` keyed letters a to p."""
    return F.substring(F.translate(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(tag), entity), 512), "0123456789abcdef", "ghijklmnopabcdef"), 1, width)


def _cased(original: Column, surrogate: Column) -> Column:
    return F.when((F.upper(original) == original) & (F.lower(original) != original), F.upper(surrogate)).otherwise(surrogate)


def kind(match: Column) -> Column:
    """Type of a match."""
    out = F.when(match.contains("@"), "email")
    for name in ("secret", "ip", "ssn", "card", "phone"):
        out = out.when(match.rlike(f"^(?:{PATTERNS[name]})$"), name)
    return out.otherwise("name")


def normal(match: Column) -> Column:
    """What is the same for all mentions of an entity."""
    type_ = kind(match)
    name = F.lower(F.trim(F.regexp_replace(_rest(match), r"[.\s\u00a0]+", " ")))
    return F.when(type_ == "email", F.lower(match)).when(type_ == "name", name).when(type_.isin("ip", "secret"), match).otherwise(F.regexp_replace(match, r"\D", ""))


def is_entity(match: Column) -> Column:
    """Whether a match is to be replaced: all but runs of digits that are no card."""
    return let(match, lambda m: ~(m.rlike(r"^\d{13,14}$") & ~_valid(m)))


def _valid(digits: Column) -> Column:
    return _luhn_digit(digits.substr(F.lit(1), F.length(digits) - 1)) == digits.substr(F.length(digits), F.lit(1)).cast("int")


def _rest(name: Column) -> Column:
    """A name without its titles."""
    return F.regexp_replace(name, rf"^(?:{_TITLED})+", "")


def _family(name: Column) -> Column:
    """The last word of a name, as it is written."""
    return F.regexp_extract(name, r"([\p{L}\p{M}'’-]+)\.?$", 1)


def _titled(matches: Column) -> Column:
    """Those matches that are names after a title."""
    return F.filter(matches, lambda m: m.rlike(rf"^{_TITLED}") & (kind(m) == "name"))


def _pattern(titled: Column) -> Column:
    """PATTERN, and for a text with titled names also their family names without the title, with known names before."""

    def bare(names):
        words = F.array_distinct(F.flatten(F.transform(names, lambda n: F.regexp_extract_all(_rest(n), F.lit(_WORD), F.lit(0)))))
        last = F.array_distinct(F.filter(F.transform(names, _family), lambda f: F.length(f) > 1))
        either = lambda some: F.array_join(some, "|")
        ahead = F.concat(F.lit("(?:(?:"), either(words), F.lit(rf"){_SPACE}){{0,99}}"))
        out = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{M}\p{N}])(?=\p{Lu})(?iu:"), ahead, F.lit("(?:"), either(last), F.lit(r"))(?![\p{L}\p{M}\p{N}])"))
        return F.when(F.size(last) > 0, out).otherwise(F.lit(PATTERN))

    return F.when(F.size(titled) > 0, bare(titled)).otherwise(F.lit(PATTERN))


def _gender(name: Column) -> Column:
    """m, f or n by the titles."""
    titles = F.regexp_extract(name, rf"^((?:{_TITLED})+)", 1)
    some = lambda g: titles.rlike("(?:" + "|".join(x for t in _TITLES[g] for x in (t, t.upper())) + r")(?!\p{L})")
    return F.when(some("m"), "m").when(some("f"), "f").otherwise("n")


def _gender_or_null(name: Column) -> Column:
    return F.when(name.isNotNull(), _gender(name))


def _gender_in(match: Column, titled: Column) -> Column:
    """The gender of a name's title; without one, that of the first name of the text with the family name and such a title, equal names first; null if the match is no name."""

    def of(own, whole, family):
        known = F.filter(titled, lambda n: (F.lower(_family(n)) == family) & (_gender(n) != "n"))
        same = F.filter(known, lambda n: normal(n) == whole)
        return F.when(own != "n", own).otherwise(F.coalesce(let(F.get(same, F.lit(0)), _gender_or_null), let(F.get(known, F.lit(0)), _gender_or_null), F.lit("n")))

    resolved = let(_gender(match), lambda g: let(normal(match), lambda w: let(F.lower(_family(match)), lambda f: of(g, w, f))))
    return F.when(kind(match) == "name", resolved)


def searched(text: Column) -> Column:
    """struct(pattern, found): the pattern for a text and its matches in order, as structs of the match m and a name's gender g."""

    def all_of(matches, titled, pattern):
        plain = F.transform(matches, lambda m: F.struct(m.alias("m"), F.lit(None).cast("string").alias("g")))
        more = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.struct(m.alias("m"), _gender_in(m, titled).alias("g")))
        return F.struct(pattern.alias("pattern"), F.when(F.size(titled) == 0, plain).otherwise(more).alias("found"))

    return let(found(text), lambda m: let(_titled(m), lambda t: let(_pattern(t), lambda p: all_of(m, t, p))))


def _syllables(key, tag: str, of: Column, n: int) -> Column:
    """n keyed syllables."""
    if not n:
        return F.lit("")
    one = lambda i: F.get(F.array(*[F.lit(x) for x in SYLLABLES]), F.pmod(F.xxhash64(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(tag), of, i.cast("string")), 256)), F.lit(len(SYLLABLES))).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), one), "")


def _by_script(original: Column, of) -> Column:
    """of(None) for an original in Latin letters, of(entry of SCRIPTS) for others."""
    out = F
    for script in SCRIPTS:
        out = out.when(original.rlike(script[0]), of(script))
    return out.otherwise(of(None))


def _initial(key, letter: Column, of: Column, abc: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> Column:
    """Another letter; distinct for distinct ones of the alphabet."""
    turn = F.pmod(_hash(key, "initial", of), F.lit(len(abc) - 1)) + 1
    at = F.position(letter, F.lit(abc))
    rare = F.concat(F.lit("X"), F.translate(F.pmod(F.ascii(letter) + turn, F.lit(1 << 21)).cast("string"), "0123456789", "abcdefghij"))  # a letter beyond the alphabet
    return F.when(at > 0, F.lit(abc).substr((F.pmod(at - 1 + turn, F.lit(len(abc))) + 1).cast("int"), F.lit(1))).otherwise(rare)


def _keyed(key: str, tries: Column | None) -> Column:
    """The key of an entity that was tried again so many times."""
    return F.lit(key) if tries is None else F.when(tries > 0, F.concat_ws("\x1f", F.lit(key), F.lit("again"), tries.cast("string"))).otherwise(F.lit(key))


def _written(like: Column, latin: Column) -> Column:
    """Syllables in the script of a word."""
    return _by_script(like, lambda x: F.translate(latin, "abdefghiklmnoprst", x[2]) if x else latin)


def _family_name(family: Column, gender: Column, key: Column) -> Column:
    """The surrogate of a family name."""
    new = F.initcap(_written(family, _syllables(key, "family", F.concat(gender, F.lower(family)), FAMILY)))
    return F.when(F.length(family) > 1, _cased(family, new)).otherwise(new)


def _renamed(name: Column, gender: Column, key: str, tries: Column | None = None, family_tries: Column | None = None) -> Column:
    """A name with a keyed family name, given names and initials; titles, particles and spaces as they are."""
    family_key = _keyed(key, family_tries)

    def of(rest, family, own, own_key):
        before = F.regexp_replace(rest, r"[\p{L}\p{M}'’-]+\.?$", "")
        dot = F.regexp_extract(rest, r"(\.?)$", 1)

        def given(w):
            pick = lambda some: F.get(F.array(*[F.lit(x) for x in some]), F.pmod(_hash(own_key, "given", F.lower(w)), F.lit(len(some))).cast("int"))
            lists = lambda x: x[1] if x else {"m": MALE, "f": FEMALE, "n": NEUTRAL}
            short = _by_script(w, lambda x: F.when(gender == "m", pick(lists(x)["m"])).when(gender == "f", pick(lists(x)["f"])).otherwise(pick(lists(x)["n"])))
            if tries is not None:
                short = F.concat(short, F.when(tries > 0, _written(w, _syllables(own_key, "given", F.lower(w), GIVEN))).otherwise(""))
            return _cased(w, short)

        initial = lambda w: _by_script(w, lambda x: _initial(own_key, w, own, x[4]) if x else _initial(own_key, w, own))
        parts = F.regexp_extract_all(before, F.lit(r"\p{L}[\p{L}\p{M}'’-]*|[^\p{L}]+"), F.lit(0))
        new = F.transform(parts, lambda w: F.when(~w.rlike(r"^\p{Lu}"), w).when(F.length(w) == 1, initial(w)).otherwise(given(w)))
        return F.concat(name.substr(F.lit(1), F.length(name) - F.length(rest)), F.array_join(new, ""), _family_name(family, gender, family_key), dot)

    return let(_rest(name), lambda r: let(_family(r), lambda f: let(F.concat(gender, F.lower(f)), lambda own: let(_keyed(key, tries), lambda k: of(r, f, own, k)))))


def _secret(secret: Column, key: Column) -> Column:
    """A secret with keyed characters, each of its kind; in blocks of 64, each from the digest of the whole and its place."""
    prefix = F.regexp_extract(secret, r"^(AKIA|gh[pousr]_|sk-(?:[a-z]{2,8}\d{0,2}-)?(?=[0-9A-Za-z_-]{20}))", 1)

    def of(rest, hexadecimal, whole):
        def char(c, at, random):
            value = F.conv(random.substr(2 * at + 1, F.lit(2)), 16, 10).cast("int")
            one = lambda abc: F.lit(abc).substr(F.pmod(value, F.lit(len(abc))) + 1, F.lit(1))
            letter = lambda abc: F.when(hexadecimal, one(abc[:6])).otherwise(one(abc))
            return F.when(c.rlike("[0-9]"), one("0123456789")).when(c.rlike("[a-z]"), letter("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

        block = lambda b, i: let(F.sha2(F.concat_ws("\x1f", whole, i.cast("string")), 512), lambda r: F.array_join(F.transform(F.split(b, ""), lambda c, at: char(c, at, r)), ""))
        return F.array_join(F.transform(F.regexp_extract_all(rest, F.lit(".{1,64}"), F.lit(0)), block), "")

    new = lambda p: let(F.substring(secret, F.length(p) + 1, F.length(secret)), lambda r: of(r, F.length(p) == 0, F.sha2(F.concat_ws("\x1f", key, F.lit("secret"), secret), 256)))
    return let(prefix, lambda p: F.concat(p, new(p)))


def surrogate(match: Column, key: str = KEY, gender: Column | None = None, tries: Column | None = None, family_tries: Column | None = None) -> Column:
    """The replacement of one match; gender: of a name, by its title if not given; tries: how often it was tried again."""

    def of(m, own_key):
        digits = F.regexp_replace(m, r"\D", "")
        email = _cased(m, F.concat(let(_letters(own_key, "email", F.lower(m), ADDRESS), lambda a: _by_script(F.substring_index(m, "@", 1), lambda x: F.translate(a, "abcdefghijklmnop", x[3]) if x else a)), F.lit("@mail.example.com")))

        # a telephone's country code stays: after a '+', or what is before the last ten digits
        code = F.when(m.startswith("+"), F.length(F.regexp_extract(m, COUNTRY, 1))).otherwise(F.greatest(F.length(digits) - 10, F.lit(0)))
        phone = let(code, lambda c: _into(m, F.concat(digits.substr(F.lit(1), c), _permuted_digits(own_key, digits.substr(c + 1, F.length(digits)), "phone"))))

        def card_of(d):
            body = d.substr(F.lit(1), F.length(d) - 1)
            shift = F.pmod(d.substr(F.length(d), F.lit(1)).cast("int") - _luhn_digit(body), F.lit(10))  # 0: a valid number
            return let(_permuted_digits(own_key, body, "card"), lambda b: F.concat(b, F.pmod(_luhn_digit(b) + shift, F.lit(10)).cast("string")))

        card = F.when(is_entity(m), _into(m, let(digits, card_of))).otherwise(m)
        ssn = _into(m, _permuted_digits(own_key, digits, "ssn"))

        def ip_of(o):
            pair = _feistel(own_key, o[0].cast("long") * 256 + o[1].cast("long"), o[2].cast("long") * 256 + o[3].cast("long"), F.lit(65536), F.lit(65536), F.lit("ip"))
            return let(pair, lambda s: F.concat_ws(".", *[F.floor(x / 256).cast("string") if high else F.pmod(x, F.lit(256)).cast("string") for x in (s["l"], s["r"]) for high in (True, False)]))

        ip = let(F.split(m, r"\."), ip_of)
        name = _renamed(m, _gender(m) if gender is None else gender, key, tries, family_tries)
        return let(kind(m), lambda k: F.when(k == "email", email).when(k == "secret", _secret(m, own_key)).when(k == "ip", ip).when(k == "ssn", ssn).when(k == "card", card).when(k == "phone", phone).otherwise(name))

    return let(match, lambda m: let(_keyed(key, tries), lambda k: of(m, k)))


def _may_have(text: Column) -> Column:
    """A cheap test that all texts with a match pass."""
    return (F.length(F.translate(text, "0123456789@", "")) < F.length(text)) | text.rlike(_HINT)


def found(text: Column) -> Column:
    """All matches of a text, in order."""
    return F.when(_may_have(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _entity(kind_: Column, gender: Column, name: Column) -> Column:
    """One string for an entity."""
    return F.concat_ws("\x1f", kind_, F.coalesce(gender, F.lit("")), name)


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """All entities of all texts with one mention m each (print of the text, kind, gender, name); family names also alone."""
    rows = docs.select(text_print(text).alias("print"), F.explode(searched(F.col(text))["found"]).alias("x")).select("print", "x.*").where(is_entity(F.col("m")))
    one = lambda k, m: F.struct(k.alias("kind"), F.col("g"), F.when(k == "family", F.lower(m)).otherwise(normal(m)).alias("name"), m.alias("m"))
    own = let(kind(F.col("m")), lambda k: F.when(k == "name", F.array(one(F.lit("name"), F.col("m")), one(F.lit("family"), _family(F.col("m"))))).otherwise(F.array(one(k, F.col("m")))))
    return rows.select("print", F.explode(own).alias("x")).select("print", "x.*")


def _settled(entities: DataFrame, again, real: DataFrame) -> DataFrame:
    """entities (kind, g, name, m, ...) with the number of tries after which no two share a surrogate and none has a real one's.

    again: the surrogate's name, as an expression of the columns and `tries`.
    """
    # written and read again each time: a checkpoint keeps the optimizer's guess of its size, which grows with each join
    rows, path = common.stored(entities.withColumn("tries", F.lit(0)).withColumn("s", again), "entities")
    key = F.struct("name", "g")
    for _ in range(TRIES):
        keeper = rows.groupBy("kind", "s").agg(F.count("*").alias("n"), F.min(key).alias("keeper")).where("n > 1").drop("n")
        lost = rows.join(keeper, ["kind", "s"]).where(key != F.col("keeper")).select("kind", "g", "name")
        lost = lost.union(rows.join(real.withColumnRenamed("name", "s"), ["kind", "s"], "left_semi").select("kind", "g", "name")).distinct()
        lost = common.cut(lost.withColumn("lost", F.lit(True)))
        if lost.isEmpty():
            return rows.drop("s")
        same = (rows["kind"] == lost["kind"]) & rows["g"].eqNullSafe(lost["g"]) & (rows["name"] == lost["name"])
        rows = rows.join(lost, same, "left").select(*[rows[c] for c in rows.columns if c not in ("tries", "s")], (rows["tries"] + F.when(F.col("lost"), 1).otherwise(0)).alias("tries"), F.col("s").alias("was"), "lost")
        before = path
        rows, path = common.stored(rows.withColumn("s", F.when(F.col("lost"), again).otherwise(F.col("was"))).drop("lost", "was"), "entities")
        common.drop(entities.sparkSession, before)
    raise ValueError("surrogates still collide")


def tried_again(found: DataFrame, key: str = KEY) -> DataFrame:
    """entity and tries of those entities whose first surrogate collides; found: as `mentions` gives it."""
    entities = common.cut(found.groupBy("kind", "g", "name").agg(F.min("m").alias("m")))
    real = entities.select("kind", "name").distinct()
    family = _family_name(F.col("m"), F.col("g"), _keyed(key, F.col("tries")))
    again = F.when(F.col("kind") == "family", F.lower(family)).otherwise(let(surrogate(F.col("m"), key, F.col("g"), F.col("tries")), normal))
    settled = _settled(entities.where("kind <> 'name'"), again, real)
    families = settled.where("kind = 'family'").select(F.col("name").alias("family"), F.col("g").alias("family_g"), F.col("tries").alias("family_tries"))
    names = entities.where("kind = 'name'").withColumn("family", F.lower(_family(F.col("m"))))
    names = names.join(families, (names["family"] == families["family"]) & names["g"].eqNullSafe(families["family_g"])).select("kind", "g", "name", "m", "family_tries")
    whole = let(surrogate(F.col("m"), key, F.col("g"), F.col("tries"), F.col("family_tries")), normal)
    # one word alone is decided as a family name
    some = names.where(F.col("name").contains(" "))
    out = settled.select("kind", "g", "name", "tries").union(_settled(some, whole, real).select("kind", "g", "name", "tries"))
    return out.where("tries > 0").select(_entity(F.col("kind"), F.col("g"), F.col("name")).alias("entity"), "tries")


def replaced(docs: DataFrame, key: str = KEY, check: bool = True, text: str = "text", count: str | None = None) -> DataFrame:
    """All rows and columns with surrogates in the text, and optionally a column with the number of replacements.

    check: compare all entities of the corpus and their surrogates, and try again those that collide.
    """
    one, columns, tries = F.col(text), docs.columns, None
    names = []
    for name in ("_surrogates", "_tries", "_print"):
        while name.lower() in (c.lower() for c in columns):
            name += "_"
        names.append(name)
    if check:
        found = common.cut(mentions(docs, text))
        tried = common.cut(tried_again(found, key))
        if not tried.isEmpty():
            # the tries of a text's entities, for the few texts that need any
            own = found.withColumn("entity", _entity(F.col("kind"), F.col("g"), F.col("name"))).join(tried, "entity")
            own = own.groupBy(F.col("print").alias(names[2])).agg(F.map_from_entries(F.collect_set(F.struct("entity", "tries"))).alias(names[1]))
            own = common.cut(own)
            docs = docs.join(F.broadcast(own) if own.count() <= BROADCAST_TEXTS else own, text_print(text) == F.col(names[2]), "left").drop(names[2])
            tries = F.col(names[1])

    def new(x):
        if tries is None:
            return surrogate(x["m"], key, x["g"])
        of = lambda k, name: F.coalesce(F.element_at(tries, _entity(k, x["g"], name)), F.lit(0))
        both = F.struct(of(kind(x["m"]), normal(x["m"])).alias("own"), of(F.lit("family"), F.lower(_family(x["m"]))).alias("family"))
        return let(both, lambda n: surrogate(x["m"], key, x["g"], n["own"], n["family"]))

    def joined(matches, pattern):
        pieces = F.split(one, pattern, -1)
        return F.when(F.size(matches) == 0, one).otherwise(F.array_join(F.zip_with(pieces, matches, lambda p, x: F.concat(p, F.when(x.isNull(), "").otherwise(new(x)))), ""))

    number = lambda matches: F.size(F.filter(matches, lambda x: is_entity(x["m"]))).cast("long")
    both = F.when(one.isNotNull(), let(searched(one), lambda s: F.struct(joined(s["found"], s["pattern"]).alias("text"), number(s["found"]).alias("n"))))
    rows = docs.withColumn(names[0], both)
    rows = rows.withColumn(text, F.col(f"{names[0]}.text"))
    if count:
        rows = rows.withColumn(count, F.coalesce(F.col(f"{names[0]}.n"), F.lit(0).cast("long")))
    return rows.drop(*names)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return replaced(docs, count="n_replaced")
