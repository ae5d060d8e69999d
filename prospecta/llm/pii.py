"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Detected: e-mail addresses, telephone numbers, IPv4 addresses, payment card numbers, US social security
numbers, IBANs, and names: up to three capitalised words behind a form of address, and from then on each of these words
wherever it occurs capitalised in the same text ("Mr. John Smith ... Smith"). A word that the text also has alone behind a form of
address is a surname and ends a name ("Mr. Smith", "Mr. Smith Went home"). Names that no text introduces by a form of address stay.

A mention has a kind and a canonical form (case, spaces and punctuation aside); the canonical form alone decides the surrogate,
so all mentions of one entity get the same one (coreference), written in the mention's own layout and case. A name is replaced word by word, by gender and
script: given name and surname each keep their own surrogate, so "Mr. Smith" stays the same person as "Mr. John Smith". Card numbers
that pass the Luhn check get surrogates that pass it; country codes, separators and the number of digits stay; so do length and separators of an address before the @.

A surrogate comes from HMAC-SHA256 under a secret key of the kind, the canonical form and an attempt number. Collision
check: of two entities of a kind with one surrogate the one that sorts first keeps it, and no
surrogate may be an entity that occurs in the table; the others try again, with longer words, until none is left. Where a
format has fixed room (telephone numbers of a few digits) and ATTEMPTS tries leave entities over, a ValueError says so. The
result depends on the table's set of entities and the key, not on partitioning.

Only distinct lists of mentions are exploded and joined, so groups of copies cost one row, and only
texts with a mention are shuffled. All patterns have bounded repeats or none that can give back, so texts of any length end. Null texts stay null, with 0
mentions; empty texts stay empty; repeated rows are treated alike. Other columns pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.llm.cluster import cut

# Forms of address by gender.
MALE = ("Mr", "Mr.", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr.", "Господин", "Κύριος")
FEMALE = ("Mrs", "Mrs.", "Ms", "Ms.", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra.", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Dr.", "Prof.", "Professor", "Доктор", "Δρ.")
# Syllables that surrogate words are made of, by script, and the endings of given names by gender.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga go ka ke ki ko la le li lo ma me mi mo na ne ni no".split(),
    "cyrillic": "ба бе би бо да де ди до ва ве ви во га го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но".split(),
    "greek": "βα βε βι βο δα δε δι δο φα φε φι φο γα γο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο".split(),
    "han": "安 白 成 达 恩 方 光 海 华 嘉 建 金 静 康 乐 林 明 南 宁 平 庆 仁 荣 思 泰 文 喜 贤 雅 永".split(),
}
ENDINGS = {
    "latin": {"m": "n", "f": "ra", "n": "s"},
    "cyrillic": {"m": "н", "f": "ра", "n": "с"},
    "greek": {"m": "ς", "f": "ρα", "n": "ν"},
    "han": {"m": "伟", "f": "丽", "n": "之"},
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# A name of the domain system has 127 labels at most.
EMAIL = r"(?<![\w.+-])[\w.+-]{1,64}+@(?:[\w-]{1,63}+\.){1,126}\p{L}{2,63}+"
PHONE = r"(?<![\w.+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w]|[.-][0-9])"
IP = rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.[0-9])"
CARD = r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w]|[.-][0-9])"
SSN = r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w]|[.-][0-9])"
IBAN = r"(?<![\w])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![\w])"
_TITLES = "|".join(sorted((t.replace(".", r"\.") for t in (*MALE, *FEMALE, *NEUTRAL)), key=len, reverse=True))
_WORD = r"[\p{Lu}\p{Lo}][\p{L}'’-]*+"
NAME = rf"(?<![\p{{L}}\p{{N}}_])(?:{_TITLES}) {_WORD}(?: {_WORD}){{0,2}}"
_FIRSTS = "".join(sorted({t[0] for t in (*MALE, *FEMALE, *NEUTRAL)}))
_BARE = rf"(?<![\p{{L}}\p{{N}}_]){_WORD}"
# What a mention begins with is looked at first; most places of a text are done with at that.
_PLAIN = rf"(?=[0-9+(])(?:{PHONE}|{IP}|{CARD}|{SSN})|(?=[A-Z])(?:{IBAN})|(?=[{_FIRSTS}])(?:{NAME})"
MENTION = rf"{EMAIL}|{_PLAIN}"
# The country codes of one and of two digits; all others have three.
_COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
#: Rounds of tries for surrogates that are taken.
ATTEMPTS = 30


def _found(text: Column) -> Column:
    """All mentions of a text; without an @ there is no address to look for."""
    return F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(_PLAIN), F.lit(0)))


def _has(text: Column) -> Column:
    return F.when(text.contains("@"), text.rlike(MENTION)).otherwise(text.rlike(_PLAIN))


def kind_of(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(rf"^(?:{_TITLES}) "), "name")
        .when(m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
        .when(m.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4,6}[ -].*)$"), "card")
        .otherwise("phone")
    )


def _gender(m: Column) -> Column:
    title = F.substring_index(m, " ", 1)
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").when(word.rlike(r"\p{IsHan}"), "han").otherwise("latin")


def _name_words(m: Column) -> Column:
    return F.slice(F.split(m, " "), 2, 10)


def _stem(w: Column) -> Column:
    """A name's word in lower case, without the ending of the genitive."""
    return F.regexp_replace(F.lower(w), "['’]s$", "")


def _ending(w: Column) -> Column:
    return F.regexp_extract(w, "['’][sS]$", 0)


def entities_of(m: Column) -> Column:
    """The entities of a mention, in order, as (kind, form): one, or one for each word of a name.

    The last word of a name is a surname, those before are given names with the gender of the address.
    """
    kind = kind_of(m)
    one = lambda k, form: F.struct(k.alias("kind"), form.alias("form"))
    words = _name_words(m)
    # A word alone or last is a surname.
    named = F.transform(
        words,
        lambda w, i: one(F.concat(F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given_"), _gender(m))), F.lit(":"), _script(w)), _stem(w)),
    )
    digits = F.regexp_replace(m, "[^0-9]", "")
    form = F.when((kind == "phone") & m.startswith("+"), F.concat(F.lit("+"), digits)).when(kind.isin("phone", "card", "ssn"), digits).otherwise(F.lower(m))
    return F.when(kind == "name", named).otherwise(F.array(one(kind, form)))


def _parts(lists: DataFrame) -> DataFrame:
    """(list, at, m, part, kind, form): the entities of each list's mentions. A word that stands alone behind a form of address of the list ends a name."""
    mentions = lists.select("list", F.posexplode("ms").alias("at", "m")).withColumn("entities", entities_of(F.col("m")))
    parts = mentions.select("list", "at", "m", F.size("entities").alias("size"), F.posexplode("entities").alias("part", "entity")).select("list", "at", "m", "size", "part", "entity.*")
    alone = parts.where("size = 1 and kind like 'surname:%'").select("list", "form").distinct()
    ends = parts.where("size > 1").join(alone, ["list", "form"], "left_semi").groupBy("list", "at").agg(F.min("part").alias("end"))
    kind = F.when(F.col("part") == F.col("end"), F.concat(F.lit("surname:"), F.substring_index("kind", ":", -1))).otherwise(F.col("kind"))
    return parts.join(ends, ["list", "at"], "left").where("end is null or part <= end").select("list", "at", "m", "part", kind.alias("kind"), "form")


def _digits(h: Column) -> Column:
    """30 decimal digits of a hex digest."""
    return F.concat(*(F.right(F.lpad(F.conv(F.substring(h, at, 15), 16, 10), 18, "0"), F.lit(15)) for at in (1, 16)))


def _word(h: Column, script: str, at: int, syllables: int) -> Column:
    table = F.array(*map(F.lit, SYLLABLES[script]))
    pick = lambda k: F.element_at(table, (F.conv(F.substring(h, at + 4 * k, 4), 16, 10).cast("int") % len(SYLLABLES[script]) + 1).cast("int"))
    return F.concat(*(pick(k) for k in range(syllables)))


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number; the last digit counts once."""
    listed = F.reverse(F.filter(F.split(digits, ""), lambda d: d != ""))
    values = F.transform(listed, lambda d, i: F.when(i % 2 == 1, (2 * d.try_cast("int")) % 10 + F.floor(d.try_cast("int") / 5)).otherwise(d.try_cast("int")).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hex."""
    own = key.encode()
    own = (hashlib.sha256(own).digest() if len(own) > 64 else own).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in own)), F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in own)), F.unhex(inner)), 256)


def _local_part(local: Column, h: Column) -> Column:
    """Letters for letters, in turn consonants and vowels, digits for digits; all else stays."""
    stream = F.concat(h, F.sha2(h, 256))
    draw = lambda i: F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda letters, i: F.substring(F.lit(letters), draw(i) % len(letters) + 1, F.lit(1))
    chars = F.filter(F.split(local, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[a-z]"), F.when(i % 2 == 0, pick("bdfghklmnprstvz", i)).otherwise(pick("aeiou", i))).when(c.rlike("[0-9]"), pick("0123456789", i)).otherwise(c)), "")


def surrogate_form(kind: Column, form: Column, attempt: int, key: str) -> Column:
    """The canonical form of the surrogate of (kind, form) at an attempt; words grow by a syllable every other attempt."""
    more = min(attempt // 2, 6)
    h = _hmac(key, F.concat_ws("\x1f", kind, form, F.lit(str(attempt))))
    digits = _digits(h)
    size = F.length(form)
    local = F.substring_index(form, "@", 1)
    email = F.concat(_local_part(local, h), F.lit("@"), _word(h, "latin", 9, 3 + more), F.lit(".example."), F.substring_index(form, ".", -1))
    number = F.substring(F.concat(digits, _digits(F.sha2(h, 256))), F.lit(1), size)
    number = F.concat(F.when(F.left(number, F.lit(1)) == "0", F.lit("7")).otherwise(F.left(number, F.lit(1))), F.substring(number, F.lit(2), size))
    kept = F.when(form.startswith("+"), F.concat(F.lit("+"), F.regexp_extract(form, _COUNTRY, 1))).otherwise(F.left(form, F.lit(1)))
    phone = F.concat(kept, F.substring(number, F.length(kept) + 1, size))
    body = F.left(number, size - 1)
    rest = _luhn_sum(F.concat(body, F.lit("0"))) % 10
    card = F.when(_luhn_sum(form) % 10 == 0, F.concat(body, ((F.lit(10) - rest) % 10).cast("string"))).otherwise(number)
    octet = lambda at: F.conv(F.substring(h, at, 4), 16, 10).cast("int")
    # Reserved addresses first, the whole range once they are crowded.
    ip = F.concat_ws(".", octet(1) % 15 + 240 if attempt < 8 else octet(1) % 223 + 1, octet(5) % 256, octet(9) % 256, octet(13) % 254 + 1)
    iban = F.concat(F.left(form, F.lit(2)), F.left(digits, F.lit(2)), F.left(F.concat(F.substring(digits, 3, 28), digits), size - 4))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind == "ssn", F.concat(F.lit("9"), F.substring(number, 2, 8)))
    for script in SYLLABLES:
        out = out.when(kind == f"surname:{script}", _word(h, script, 1, (2 if script == "han" else 4) + more))
        for gender, end in ENDINGS[script].items():
            out = out.when(kind == f"given_{gender}:{script}", F.concat(_word(h, script, 1, (2 if script == "han" else 3) + more), F.lit(end)))
    return out.otherwise(phone)


def _cased(word: Column, form: Column) -> Column:
    """A surrogate word in the case of the word that it stands for, with that one's ending."""
    stem = F.regexp_replace(word, "['’][sS]$", "")
    return F.concat(F.when((F.upper(stem) == stem) & (F.length(stem) > 1) & (F.lower(stem) != stem), F.upper(form)).otherwise(F.initcap(form)), _ending(word))


def _laid_out(m: Column, kind: Column, forms: Column) -> Column:
    """The surrogate forms in the layout and case of the mention."""
    digits = F.filter(F.split(forms[0], ""), lambda d: d.rlike("[0-9]"))
    spaced = F.array_join(F.zip_with(F.split(m, "[0-9]"), digits, lambda s, d: F.concat(F.coalesce(s, F.lit("")), F.coalesce(d, F.lit("")))), "")
    chars = lambda c: F.filter(F.split(F.substring_index(c, "@", 1), ""), lambda x: x != "")
    local = F.array_join(F.zip_with(chars(m), chars(forms[0]), lambda w, f: F.when(w.rlike("[A-Z]"), F.upper(f)).otherwise(f)), "")
    domain, had = F.substring_index(forms[0], "@", -1), F.substring_index(m, "@", -1)
    email = F.concat(local, F.lit("@"), F.when(F.upper(had) == had, F.upper(domain)).otherwise(domain))
    words = _name_words(m)
    name = F.concat(F.zip_with(F.slice(words, F.lit(1), F.size(forms)), forms, _cased), F.slice(words, F.size(forms) + 1, F.lit(10)))
    name = F.concat(F.substring_index(m, " ", 1), F.lit(" "), F.array_join(name, " "))
    return F.when(kind.isin("phone", "card", "ssn"), spaced).when(kind == "name", name).when(kind == "iban", F.upper(forms[0])).when(kind == "email", email).otherwise(forms[0])


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) for distinct (kind, form) rows: distinct surrogates, none of them an entity of the table."""
    entities = cut(entities)
    settled, pending = None, entities
    for attempt in range(ATTEMPTS):
        tried = pending.withColumn("surrogate", surrogate_form(F.col("kind"), F.col("form"), attempt, key))
        firsts = tried.groupBy("kind", "surrogate").agg(F.min("form").alias("form"))
        free = firsts.join(entities.select(F.col("form").alias("surrogate")).distinct(), "surrogate", "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = cut(free.select("kind", "form", "surrogate"))
        settled = won if settled is None else settled.unionByName(won)
        pending = cut(pending.join(won, ["kind", "form"], "left_anti"))
        if pending.isEmpty():
            return settled
    row = pending.groupBy("kind", F.length("form").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).first()
    raise ValueError(f"no room for distinct surrogates: {row.n} entities of kind {row.kind} and {row.size} characters are left after {ATTEMPTS} attempts")


def _names(parts: DataFrame, named: DataFrame) -> DataFrame:
    """(list, words): for each list of mentions, the words of its names and their surrogates; a surname goes before a given name."""
    words = parts.where("kind like 'surname:%' or kind like 'given%'").join(named, ["kind", "form"])
    one = words.groupBy("list", "form").agg(F.max(F.struct("kind", "surrogate")).alias("e"))
    return one.groupBy("list").agg(F.map_from_entries(F.collect_list(F.struct("form", "e.surrogate"))).alias("words"))


def _woven(between: Column, put: Column) -> Column:
    return F.array_join(F.zip_with(between, put, lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit("")))), "")


def surrogates(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every mention in ``text_col`` replaced; ``count_col`` names a column for the number of mentions."""
    names = {c.lower() for c in docs.columns}
    own = next(f"_m{k}" for k in range(1000) if not {f"_m{k}{x}" for x in ("", "_key", "_list", "_ss", "_words", "_gaps")} & names)
    text = F.col(f"`{text_col}`")
    marked = docs.where(_has(text)).withColumn(own, _found(text))
    marked = marked.withColumn(f"{own}_key", F.sha2(F.array_join(own, "\x1f"), 256))
    lists = cut(marked.groupBy(F.col(f"{own}_key").alias("list")).agg(F.first(own).alias("ms")))
    parts = cut(_parts(lists))
    named = assign(parts.select("kind", "form").distinct(), key)
    forms = parts.join(named, ["kind", "form"]).groupBy("list", "at", "m").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "surrogate"))), lambda x: x.surrogate).alias("forms"))
    written = forms.select("list", "at", _laid_out(F.col("m"), kind_of(F.col("m")), F.col("forms")).alias("s"))
    by_list = written.groupBy("list").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x.s).alias("ss")).join(_names(parts, named), "list", "left")
    by_list = by_list.select(F.col("list").alias(f"{own}_list"), F.col("ss").alias(f"{own}_ss"), F.col("words").alias(f"{own}_words"))
    gaps, words = F.when(text.contains("@"), F.split(text, MENTION, -1)).otherwise(F.split(text, _PLAIN, -1)), F.col(f"{own}_words")
    done = marked.join(by_list, F.col(f"{own}_key") == F.col(f"{own}_list")).withColumn(f"{own}_gaps", gaps)
    # Other capitalised words stay as they are.
    again = lambda g: F.regexp_extract_all(g, F.lit(_BARE), F.lit(0))
    known = lambda w: F.coalesce(words[F.lower(w)], words[_stem(w)])
    rewritten = lambda g: _woven(F.split(g, _BARE, -1), F.transform(again(g), lambda w: F.coalesce(_cased(w, known(w)), w)))
    between = F.when(words.isNull(), F.col(f"{own}_gaps")).otherwise(F.transform(f"{own}_gaps", rewritten))
    bare = F.when(words.isNull(), F.lit(0)).otherwise(F.aggregate(f"{own}_gaps", F.lit(0), lambda a, g: a + F.size(F.filter(again(g), lambda w: known(w).isNotNull()))))
    count = [] if count_col is None else [(F.size(f"{own}_ss") + bare).alias(count_col)]
    none = [] if count_col is None else [F.lit(0).alias(count_col)]
    keep = lambda value: [value.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    left = docs.where(text.isNull() | ~_has(text)).select(*keep(text), *none)
    return left.unionByName(done.select(*keep(_woven(between, F.col(f"{own}_ss"))), *count))
