"""Format-preserving pseudonyms for personal data, in Spark expressions only.

Candidates are found by one pattern; numbers are validated (card check digit, digits of
a phone number, social-security ranges, IP octets, calendar dates) and those that fail
are left alone.  In a run of digit groups each part that is laid out as a card is tried.
The value becomes a short array of numbers, each below its own modulus, and a keyed
Feistel network over them (each number in turn shifted by a digest of the others)
permutes exactly the values of that format.  Equal values get equal pseudonyms in all
documents, different values different ones.  The permutation of a row needs nothing but
that row, so there is no shuffle and no shared state.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martingrid.llm.common import let

#: Set your own for real data; pseudonyms can only be linked under one key.
KEY = "martingrid-demo-key"
#: Times that the network shifts each number.
ROUNDS = 4
#: 400 Gregorian years, from this day, have so many days; the two factors below multiply to it.
FIRST_DAY, DAY_FACTORS = "1700-01-01", (189, 773)

#: So many days of 400 years come after the twelfth of their month; moduli that multiply to it.
LATE_FACTORS = (9, 9833)
#: Groups of a card by the mark of its layout: one of 13 to 19 digits; 4 6 4 or 4 6 5; four of 4; four of 4 and one of 1 to 3.
LAYOUTS = {"A": 1, "C": 3, "D": 4, "E": 5}
#: Leftmost cards that do not overlap, from the best layout that fits at each group.
_TAKEN = "|".join(f"{mark}.{{{n - 1}}}" for mark, n in LAYOUTS.items()) + "|0"
#: Times that a card is permuted until its surroundings give the same cards as before; half as many already have a chance below 1e-10 not to do. One that needs more raises.
WALKS = 64

#: What a run of digit groups ends before, as it is of another kind.
_OTHER = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|[0-9]{3}-[0-9]{2,3}-[0-9]{4}(?![0-9-])|[0-9]+[./]"
#: Patterns by kind; no two kinds match at the same place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}+\.)++[A-Za-z]{2,24}",
    "phone": r"(?:(?:\+1(?:[ .-]|(?=\())|(?<![\w.+-])(?:1[ .-])?)(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?|[0-9]{3}-[0-9]{3}-|[0-9]{3}\.[0-9]{3}\.)[0-9]{4}"
    r"|\+1 [0-9]{3} [0-9]{3} [0-9]{4}|\+[0-9](?:[ .()-]{0,2}[0-9]){7,14})(?![0-9])",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?![\w-])|(?=[Tt][0-9]))",
    "slashed": r"(?<![\w/-])(?:[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\w/-])",
    "dotted": r"(?<![\w.-])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![\w-]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": rf"(?<![\w.-])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:(?: (?!{_OTHER})|-)[0-9]++(?![A-Za-z_]|-(?![0-9])))*+(?![\w-])",
    "secret": r"(?:(?<!\w)|(?<=\b0[xX]))(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|[0-9a-fA-F]{32,}+)(?!\w)",
}
PATTERN = "|".join(PATTERNS.values())


def _prf(key: str, step: Column, others: Column) -> Column:
    """48 bits of a keyed digest."""
    message = F.concat_ws("|", F.lit(key), step.cast("string"), F.array_join(others.cast("array<string>"), ","))
    return F.conv(F.substring(F.sha2(message, 256), 1, 12), 16, 10).cast("long")


def feistel(parts: Column, moduli: Column, key: str, forward: bool = True) -> Column:
    """The parts, each below its modulus (at most 2^48), permuted; ``forward=False`` undoes it."""

    def shift(state: Column, step: Column) -> Column:
        at = (step % F.size(parts)).cast("int")
        others = F.transform(state, lambda x, i: F.when(i == at, F.lit(0)).otherwise(x))
        return let(
            _prf(key, step, others),
            lambda f: F.transform(state, lambda x, i: F.when(i == at, F.pmod(x + (f if forward else -f), F.get(moduli, i))).otherwise(x)),
        )

    last = F.size(parts) * ROUNDS - 1
    steps = F.sequence(F.lit(0), last, F.lit(1)) if forward else F.sequence(last, F.lit(0), F.lit(-1))
    return F.aggregate(steps, parts, shift)


def _shift(parts: Column, moduli: Column, key: str, forward: bool, back) -> Column:
    """``back`` applied to the permuted parts, each expression evaluated once."""
    return let(F.struct(parts.cast("array<bigint>").alias("p"), moduli.cast("array<bigint>").alias("m")), lambda s: let(feistel(s["p"], s["m"], key, forward), back))


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def luhn_sum(digits: Column) -> Column:
    """Card checksum of a digit string; valid numbers give a multiple of ten."""

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (F.lit(1) + (F.length(digits) - i) % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, x: a + x)


def _pad(x: Column, width) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def _fill(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced in order."""
    place = lambda i: F.length(F.regexp_replace(F.substring(template, F.lit(1), i), "[^0-9]", ""))
    char = lambda i: F.substring(template, i, F.lit(1))
    return F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(template)), lambda i: F.when(char(i).rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(char(i))), ""
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _halves(digits: Column, key: str, forward: bool, back) -> Column:
    """``back`` applied to the digit string, permuted among those of its length (2 to 36)."""
    left, right = F.floor(F.length(digits) / 2).cast("int"), F.length(digits) - F.floor(F.length(digits) / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")
    parts = F.array(F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, right).cast("long"))
    return _shift(parts, F.array(size(left), size(right)), key, forward, lambda p: back(F.concat(_pad(F.get(p, F.lit(0)), left), _pad(F.get(p, F.lit(1)), right))))


def _valid_card(m: Column) -> Column:
    return let(_digits(m), lambda d: luhn_sum(d) % 10 == 0)


def _one_card(m: Column, key: str, forward: bool) -> Column:
    """All digits but the last are permuted; the last is set so that the checksum holds."""
    close = lambda b: _fill(m, F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
    return let(_digits(m), lambda d: _halves(F.substring(d, F.lit(1), F.length(d) - 1), f"{key}/card", forward, lambda p: let(p, close)))


def _groups(m: Column) -> Column:
    """The digit groups of a run, each with the mark before it."""
    return F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0))


def _part(values: Column, start: Column, n: Column) -> Column:
    """``n`` values from index ``start`` on, in time that grows with ``n`` only."""
    return F.when(n > 0, F.transform(F.sequence(start, start + n - 1), lambda j: F.get(values, j))).otherwise(F.array().cast("array<string>"))


def _marks(groups: Column, short: Column) -> Column:
    """For each group of a run: 0 if no card has it, the mark of its layout where a card starts (W: the whole run), - inside.

    ``short`` says that the run may be one card of any grouping.  A group's share of the
    checksum is formed once, for an even and an odd number of digits behind it, so that
    a card is tested by at most five additions.
    """

    def share(g: Column) -> Column:
        d = F.translate(g, " -", "")
        card = F.length(d) <= 19
        return F.struct(F.length(d).alias("n"), F.when(card, luhn_sum(d)).otherwise(1).alias("even"), F.when(card, luhn_sum(F.concat(d, F.lit("0")))).otherwise(1).alias("odd"))

    def layouts(h: Column) -> Column:
        def best(i: Column) -> Column:
            at = lambda k: F.get(h, i + k)
            n = lambda k: at(k)["n"]
            total = lambda parity, ks: sum((at(k)[parity] for k in ks[1:]), at(ks[0])[parity])
            fours = (n(0) == 4) & (n(1) == 4) & (n(2) == 4) & (n(3) == 4)
            before = lambda ks, last: F.when(n(last) % 2 == 0, total("even", ks)).otherwise(total("odd", ks)) + at(last)["even"]
            return (
                F.when(n(0).between(13, 19) & (at(0)["even"] % 10 == 0), "A")
                .when(fours & n(4).between(1, 3) & (before([0, 1, 2, 3], 4) % 10 == 0), "E")
                .when(fours & (total("even", [0, 1, 2, 3]) % 10 == 0), "D")
                .when((n(0) == 4) & (n(1) == 6) & n(2).between(4, 5) & (before([0, 1], 2) % 10 == 0), "C")
                .otherwise("0")
            )

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(h) - 1), best), "")

    spread = lambda mark, n: F.concat(F.array(mark), F.array_repeat(F.lit("-"), n - 1))
    parts = F.flatten(F.transform(F.regexp_extract_all(let(F.transform(groups, share), layouts), F.lit(_TAKEN), F.lit(0)), lambda t: spread(F.substring(t, 1, 1), F.length(t))))
    whole = let(F.when(short, F.array_join(groups, "")), lambda m: m.rlike("^[0-9](?:[ -]?[0-9]){12,18}$") & _valid_card(m))
    return F.when(short & whole, spread(F.lit("W"), F.size(groups))).otherwise(parts)


def _card(m: Column, key: str, forward: bool) -> Column:
    """A run with its cards permuted, in time that grows with its length.

    The cards of a run do not depend on one another: what could turn a permuted card into
    another one are only the free groups before it, at most three, and a short group
    behind it, which stay.  A card is permuted until they give the same cards as before,
    so that the same are found again.  A run that may be one card is looked at as a whole.
    """

    def of_card(s: Column, i: Column) -> Column:
        g, k = s["g"], s["k"]
        mark = F.get(k, i)
        n = F.when(mark == "W", F.size(g))
        for x, size in LAYOUTS.items():
            n = n.when(mark == x, size)
        free = lambda d: F.coalesce(F.get(k, i - d) == "0", F.lit(False))
        before = F.when(s["short"], i).when(~free(1), 0).when(~free(2), 1).when(~free(3), 2).otherwise(3)
        behind = let(n, lambda z: F.when(s["short"], F.size(g) - i - z).when(F.length(F.translate(F.get(g, i + z), " -", "")) <= 3, 1).otherwise(0))

        def walked(c: Column) -> Column:
            found = lambda t: _marks(F.concat(c["left"], _groups(t), c["right"]), s["short"])
            step = lambda t: let(_one_card(t, key, forward), lambda x: F.struct(x.alias("t"), (found(x) == c["marks"]).alias("same")))
            start = F.struct(c["t"].alias("t"), F.lit(False).alias("same"))
            last = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, lambda a, _: F.when(a["same"], a).otherwise(step(a["t"])))
            return let(last, lambda a: F.when(a["same"], a["t"]).otherwise(F.raise_error(F.lit("a card was permuted too often"))))

        def context(b: Column) -> Column:
            left, own, right = _part(g, i - b["before"], b["before"]), _part(g, i, b["n"]), _part(g, i + b["n"], b["behind"])
            return let(F.struct(left.alias("left"), own.alias("own"), right.alias("right")), lambda c: let(F.struct(c["left"].alias("left"), c["right"].alias("right"), F.array_join(c["own"], "").alias("t"), _marks(F.concat(c["left"], c["own"], c["right"]), s["short"]).alias("marks")), walked))

        return let(F.struct(before.cast("int").alias("before"), n.cast("int").alias("n"), behind.cast("int").alias("behind")), context)

    def made(s: Column) -> Column:
        new = F.transform(s["g"], lambda x, i: F.when(F.get(s["k"], i) == "0", x).when(F.get(s["k"], i) == "-", "").otherwise(of_card(s, i)))
        return F.when(F.exists(s["k"], lambda x: x != "0"), F.array_join(new, "")).otherwise(m)

    def run(g: Column) -> Column:
        short = F.length(m) <= 37  # 19 digits and a mark between any two
        short = short & (F.length(F.translate(m, " -", "")) <= 19)
        return let(F.struct(g.alias("g"), short.alias("short")), lambda x: let(F.struct(x["g"].alias("g"), x["short"].alias("short"), _marks(x["g"], x["short"]).alias("k")), made))

    return let(_groups(m), run)


def _phone(m: Column, key: str, forward: bool) -> Column:
    """The digits behind the country code, which is what stands parted from them by a mark, are permuted."""

    def made(d: Column) -> Column:
        code = F.length(F.regexp_extract(m, r"^(?:\+([0-9]{1,3})|(1)(?=[ .-]))(?=[ .(-])", 0)) - F.when(m.startswith("+"), 1).otherwise(0)
        code = F.greatest(code, F.lit(0))
        return _halves(F.substring(d, code + 1, F.length(d) - code), f"{key}/phone", forward, lambda p: _fill(m, F.concat(F.substring(d, F.lit(1), code), p)))

    return let(_digits(m), made)


def _ip(m: Column, key: str, forward: bool) -> Column:
    def made(o: Column) -> Column:
        octet = lambda i: F.get(o, F.lit(i))
        parts = F.array(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3))
        text = lambda p: F.concat_ws(".", *[e.cast("string") for h in (0, 1) for e in (F.floor(F.get(p, F.lit(h)) / 256), F.get(p, F.lit(h)) % 256)])
        new = _shift(parts, F.array(F.lit(65536), F.lit(65536)), f"{key}/ip", forward, text)
        return F.when(F.forall(o, lambda x: x < 256), new).otherwise(m)

    return let(F.split(m, r"\.").cast("array<bigint>"), made)


def _date(m: Column, key: str, forward: bool, form: str = "yyyy-MM-dd") -> Column:
    """Days of the years 100 to 9699 are permuted within their 400 years."""
    a, b = DAY_FACTORS
    first = F.lit(FIRST_DAY).cast("date")

    def made(day: Column) -> Column:
        number = F.datediff(day, first)
        start, inside = F.floor(number / (a * b)) * (a * b), F.pmod(number, F.lit(a * b))
        parts = F.array(F.floor(inside / b), inside % b)
        text = lambda p: F.date_format(F.date_add(first, (start + F.get(p, F.lit(0)) * b + F.get(p, F.lit(1))).cast("int")), form)
        new = _shift(parts, F.array(F.lit(a), F.lit(b)), f"{key}/date", forward, text)
        return F.when(F.year(day).between(100, 9699), new).otherwise(m)

    return let(F.try_to_date(m, form), made)


def _late_date(m: Column, key: str, forward: bool, form: str) -> Column:
    """The same among days after the twelfth, which cannot be read with the month first."""
    a, b = LATE_FACTORS
    first = F.lit(FIRST_DAY).cast("date")
    before = lambda month: F.datediff(F.add_months(first, month), first) - month * 12

    def text(k: Column) -> Column:
        near = F.floor(k * 4800 / (a * b)).cast("int")
        month = F.array_max(F.filter(F.sequence(near - 2, near + 2), lambda x: before(x) <= k))
        return let(month, lambda x: F.date_format(F.date_add(F.add_months(first, x), (k - before(x) + 12).cast("int")), form))

    def made(day: Column) -> Column:
        months = (F.year(day) - 1700) * 12 + F.month(day) - 1
        start = F.floor(months / 4800) * (a * b)
        inside = F.pmod(before(months) + F.dayofmonth(day) - 13, F.lit(a * b))
        new = _shift(F.array(F.floor(inside / b), inside % b), F.array(F.lit(a), F.lit(b)), f"{key}/late", forward, lambda p: let(start + F.get(p, F.lit(0)) * b + F.get(p, F.lit(1)), text))
        return F.when(F.year(day).between(100, 9699) & (F.dayofmonth(day) > 12), new).otherwise(m)

    return let(F.try_to_date(m, form), made)


def _marked_date(m: Column, key: str, forward: bool, mark: str) -> Column:
    """Year first, else month first if that is a date, else day first."""
    forms = [mark.join(x) for x in (("yyyy", "MM", "dd"), ("MM", "dd", "yyyy"), ("dd", "MM", "yyyy"))]
    day_first = _late_date(m, key, forward, forms[2])
    month_first = F.when(F.try_to_date(m, forms[1]).isNotNull(), _date(m, key, forward, forms[1])).otherwise(day_first)
    return F.when(m.rlike("^[0-9]{4}"), _date(m, key, forward, forms[0])).otherwise(month_first)


def _ssn(m: Column, key: str, forward: bool) -> Column:
    """Areas 001 to 899 without 666, groups from 01, serials from 0001."""
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    parts = F.array(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1)

    def text(p: Column) -> Column:
        x, y = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        return F.concat_ws("-", _pad(x + F.when(x >= 665, 2).otherwise(1), 3), _pad(F.floor(y / 9999) + 1, 2), _pad(y % 9999 + 1, 4))

    return F.when(valid, _shift(parts, F.array(F.lit(898), F.lit(99 * 9999)), f"{key}/ssn", forward, text)).otherwise(m)


def _by_class(text: Column, key: str, forward: bool, zero: dict[str, tuple[int, int]]) -> Column:
    """Characters of each class (pattern: first code, size) are permuted as such; others stay."""

    def of_class(c: Column, f, other: Column) -> Column:
        out = None
        for p, (base, n) in zero.items():
            out = (F if out is None else out).when(c.rlike(p), f(base, n))
        return out.otherwise(other)

    def made(cs: Column) -> Column:
        parts = F.transform(cs, lambda c: of_class(c, lambda base, _: F.ascii(c) - base, F.lit(0)))
        moduli = F.transform(cs, lambda c: of_class(c, lambda _, n: F.lit(n), F.lit(1)))
        text = lambda p: F.array_join(F.transform(cs, lambda c, i: of_class(c, lambda base, _: F.char(F.get(p, i) + base), c)), "")
        return _shift(parts, moduli, key, forward, text)

    return let(_chars(text), made)


def _email(m: Column, key: str, forward: bool) -> Column:
    """Letters and digits of the local part are permuted as such; marks and the domain stay."""
    local = _by_class(F.substring_index(m, "@", 1), f"{key}/email", forward, {"[a-z]": (97, 26), "[A-Z]": (65, 26), "[0-9]": (48, 10)})
    return F.concat(local, F.lit("@"), F.substring_index(m, "@", -1))


def _hex(m: Column, key: str, forward: bool) -> Column:
    """Lower-case hexadecimal strings, twelve digits to a number."""

    def made(pieces: Column) -> Column:
        parts = F.transform(pieces, lambda x: F.conv(x, 16, 10).cast("long"))
        moduli = F.transform(pieces, lambda x: F.pow(F.lit(16.0), F.length(x)).cast("long"))
        text = lambda p: F.array_join(F.transform(pieces, lambda x, i: F.lpad(F.lower(F.hex(F.get(p, i))), F.length(x), "0")), "")
        return _shift(parts, moduli, f"{key}/secret", forward, text)

    return let(F.regexp_extract_all(m, F.lit("[0-9a-f]{1,12}"), F.lit(0)), made)


def _secret(m: Column, key: str, forward: bool) -> Column:
    """Hexadecimal strings, 64 digits at a time; upper case is lower case in capitals, of both cases each class is permuted as such."""
    pieces = lambda x, f: F.array_join(F.transform(F.regexp_extract_all(x, F.lit("[0-9a-fA-F]{1,64}"), F.lit(0)), f), "")
    lower = lambda x: pieces(x, lambda y: _hex(y, key, forward))
    mixed = pieces(m, lambda y: _by_class(y, f"{key}/hex", forward, {"[a-f]": (97, 6), "[A-F]": (65, 6), "[0-9]": (48, 10)}))
    return F.when(~m.rlike("[A-F]"), lower(m)).when(~m.rlike("[a-f]"), F.upper(lower(F.lower(m)))).otherwise(mixed)


def pseudonym(match: Column, key: str = KEY, forward: bool = True) -> Column:
    """The pseudonym of one candidate; unchanged if it is not valid."""
    kinds = {"email": _email, "phone": _phone, "ip": _ip, "date": _date, "slashed": partial(_marked_date, mark="/"), "dotted": partial(_marked_date, mark="."), "ssn": _ssn, "card": _card, "secret": _secret}
    out = None
    for k, p in PATTERNS.items():
        out = (F if out is None else out).when(match.rlike(f"^(?:{p})$"), kinds[k](match, key, forward))
    return out.otherwise(match)


def pseudonymise(text: Column, key: str = KEY, forward: bool = True) -> Column:
    """``text`` with each valid candidate replaced; ``forward=False`` restores it."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: pseudonym(m, key, forward))
    between = F.split(text, PATTERN, -1)
    woven = F.flatten(F.zip_with(between, found, lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))
    return F.when(text.rlike(PATTERN), F.array_join(woven, "")).otherwise(text)


def pseudonymise_documents(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with personal data in text replaced; row by row, lengths kept except in IP addresses.

    Null and empty texts stay; all columns are kept, n_chars is updated if there; repeated
    rows stay alike; an empty table stays empty.
    """
    out = docs.withColumn("text", pseudonymise(F.col("text").cast("string"), key))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
