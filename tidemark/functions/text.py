"""Text and timestamp expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABBREVIATIONS = sorted(
    "approx. bspw. bzw. ca. d.h. dr. e.g. etc. evtl. fig. fr. ggf. hr. i.e. inkl. mr. mrs. ms. no. nr. prof. s.o. s.u. st. str. u.a. u.s.w. usw. vgl. vs. z.b. zzgl.".split()
)
GERMAN = sorted(
    """aber am auch auf aus bei bitte danke das dass dein dem den der die dort du ein eine einem einen er es für gut haben hat hier ich ihr im immer ist ja
    jede jeden kann man mein meine meinen mit muss nach nein nicht noch oder oft schon sehr sie sind um und unser von war was weil wenn werden wie wir wird wo zu zum zur""".split()
)
ENGLISH = sorted(
    """a an and are at but did do does every for from go good has have he here i in is it its learn my new no not of often on open or our please she thank that
    the there these they this to use very was we were what when where with work yes you your""".split()
)
LANGUAGES = dict(
    x.split(":")
    for x in "ar:Arabic de:German en:English es:Spanish fr:French ha:Hausa ig:Igbo it:Italian ja:Japanese ko:Korean nl:Dutch pl:Polish pt:Portuguese ru:Russian tr:Turkish yo:Yoruba zh:Chinese".split()
)
#: The colors known by name; all others are written in digits.
NAMED_COLORS = dict(
    x.split(":")
    for x in """aqua:#ff00ffff beige:#fff5f5dc black:#ff000000 blue:#ff0000ff brown:#ffa52a2a coral:#ffff7f50 crimson:#ffdc143c cyan:#ff00ffff darkblue:#ff00008b darkgray:#ffa9a9a9
    darkgreen:#ff006400 darkgrey:#ffa9a9a9 darkorange:#ffff8c00 darkred:#ff8b0000 deeppink:#ffff1493 fuchsia:#ffff00ff gold:#ffffd700 gray:#ff808080 green:#ff008000 grey:#ff808080
    hotpink:#ffff69b4 indigo:#ff4b0082 ivory:#fffffff0 khaki:#fff0e68c lavender:#ffe6e6fa lightblue:#ffadd8e6 lightgray:#ffd3d3d3 lightgreen:#ff90ee90 lightgrey:#ffd3d3d3 lime:#ff00ff00
    magenta:#ffff00ff maroon:#ff800000 navy:#ff000080 olive:#ff808000 orange:#ffffa500 orchid:#ffda70d6 pink:#ffffc0cb plum:#ffdda0dd purple:#ff800080 red:#ffff0000 salmon:#fffa8072
    silver:#ffc0c0c0 skyblue:#ff87ceeb tan:#ffd2b48c teal:#ff008080 tomato:#ffff6347 transparent:#00000000 turquoise:#ff40e0d0 violet:#ffee82ee white:#ffffffff yellow:#ffffff00""".split()
)
CLOSERS = "[\"'”’»)\\]}]+$"
SPACE = r"(?U)\s+"
STAMP = r"(?:(\d+):)?(?:(\d+):)?(\d+)[.,](\d+)"


def collapse(text: Column) -> Column:
    """Without white space at the ends, single blanks within."""
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def normal_word(token: Column) -> Column:
    """Lower case, without what isn't a letter or number at either end."""
    return F.lower(F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def token_parts(token: Column) -> Column:
    """prefix, core, suffix: the punctuation around a token; a token of nothing else is all prefix."""
    prefix = F.regexp_extract(token, r"^[^\p{L}\p{N}]*", 0)
    rest = F.substr(token, F.length(prefix) + 1, F.length(token))
    suffix = F.regexp_extract(rest, r"[^\p{L}\p{N}]*$", 0)
    return F.struct(prefix.alias("prefix"), F.substr(rest, F.lit(1), F.length(rest) - F.length(suffix)).alias("core"), suffix.alias("suffix"))


def without_closers(token: Column) -> Column:
    return F.regexp_replace(token, CLOSERS, "")


def ends_sentence(token: Column, following: Column) -> Column:
    """Is the token the last of its sentence, given the next token (null at the end)?"""
    bare = without_closers(token)
    stem = F.substr(bare, F.lit(1), F.length(bare) - 1)
    guarded = F.lower(bare).isin(ABBREVIATIONS) | (F.length(stem) <= 1) | stem.try_cast("bigint").isNotNull() & stem.rlike(r"^[+-]?\d+$")
    dot = F.endswith(bare, F.lit("."))
    terminal = bare.rlike("[.!?…]$")
    lower_next = F.coalesce(without_closers(following).rlike(r"^\p{Ll}"), F.lit(False))
    return F.coalesce(terminal & ~(dot & guarded) & ~lower_next, F.lit(False))


def one_of(words: list[str]) -> str:
    """A pattern of the words that shares their beginnings, so that most places are left after a letter."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        parts = [c + pattern(below) for c, below in sorted(at.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return (f"(?:{body})?" if "" in at else body) if parts else ""

    return pattern(tree)


def language_score(text: Column) -> Column:
    """German 1 .. English -1, by stop words, umlauts and suffixes; 0 when there is little evidence.

    Words are runs of letters; each kind of evidence is one count of a pattern over the whole text, all in generated code."""
    low = F.lower(text)
    count = lambda pattern: F.regexp_count(low, F.lit(pattern)).cast("double")
    whole = lambda words: count(rf"(?<!\p{{L}}){one_of(words)}(?!\p{{L}})")
    de = whole(GERMAN) + 0.5 * count(r"(?:ung|keit|heit|chen)(?!\p{L})") + 2.0 * count(r"[äöüß]\p{L}*")
    en = whole(ENGLISH) + 0.5 * count(r"(?:ing|tion)(?!\p{L})")
    # no branches, so that each count is made once; + 0.0 turns -0.0 into 0.0
    return (de - en) / F.greatest(de + en, F.lit(1.0)) * (de + en >= 1).cast("double") + 0.0


def is_german(score: Column) -> Column:
    return score >= 0.34


def is_english(score: Column) -> Column:
    return score <= -0.34


def language_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.substr(code, F.lit(1), F.lit(2)))), code)


def stamp_ms(text: Column) -> Column:
    """The first timestamp in the text, [[H:]M:]S with a fraction, as ms; null without one. Fractions are cut after the third digit."""
    first, second, seconds, fraction = (F.regexp_extract(text, STAMP, k) for k in (1, 2, 3, 4))
    hours = F.when(second != "", first).otherwise("")
    minutes = F.when(second != "", second).otherwise(first)
    number = lambda c: F.when(c == "", 0).otherwise(c.try_cast("bigint"))
    ms = F.rpad(F.substr(fraction, F.lit(1), F.lit(3)), 3, "0").try_cast("bigint")
    return F.when(text.rlike(STAMP), number(hours) * 3_600_000 + number(minutes) * 60_000 + number(seconds) * 1000 + ms)


def format_stamp(ms: Column) -> Column:
    """HH:MM:SS,mmm; negative times are 0, hours may have more digits."""
    t = F.greatest(ms, F.lit(0)).cast("bigint")
    part = lambda by, mod, n: F.lpad((F.floor(t / by) % mod).cast("string"), n, "0")
    hours = F.floor(t / 3_600_000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit(","), F.lpad((t % 1000).cast("string"), 3, "0"))


def edited_stamp(text: Column) -> Column:
    """What a user typed for a time: whole ms, or a timestamp; null if neither."""
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.coalesce(F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("bigint")), stamp_ms(text))


def clock(ms: Column) -> Column:
    """MM:SS.t of a play position."""
    t = F.greatest(ms, F.lit(0)).cast("bigint")
    minutes = F.floor(t / 60_000).cast("string")
    return F.concat(F.when(F.length(minutes) < 2, F.lpad(minutes, 2, "0")).otherwise(minutes), F.lit(":"), F.lpad((F.floor(t / 1000) % 60).cast("string"), 2, "0"), F.lit("."), (F.floor(t / 100) % 10).cast("string"))


def known_color(text: Column) -> Column:
    """#rgb, #rrggbb, #aarrggbb or a name of NAMED_COLORS as #aarrggbb; null for anything else."""
    low = F.lower(text)
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in NAMED_COLORS.items() for x in pair]), low)
    wide = F.regexp_replace(low, "^#(.)(.)(.)$", "#ff$1$1$2$2$3$3")
    return F.when(low.rlike("^#[0-9a-f]{8}$"), low).when(low.rlike("^#[0-9a-f]{6}$"), F.concat(F.lit("#ff"), F.substr(low, F.lit(2), F.lit(6)))).when(low.rlike("^#[0-9a-f]{3}$"), wide).otherwise(named)


def color(text: Column, fallback: str) -> Column:
    return F.coalesce(known_color(text), F.lit(fallback))


def highlight_spec(spec: Column) -> Column:
    """word=color[:bold] as a struct; null when it isn't one, or there is no such color. Of several =, the first counts; bold in any case of letters."""
    pattern = r"(?si)^([^=]+)=(.*?)(:bold)?$"
    part = lambda k: F.regexp_extract(spec, pattern, k)
    return F.when(spec.rlike(pattern) & known_color(part(2)).isNotNull(), F.struct(part(1).alias("word"), part(2).alias("color"), (part(3) != "").alias("bold")))


def is_project(path: Column, extension: str = "tmproj") -> Column:
    return F.endswith(F.lower(path), F.lit(f".{extension.lower()}"))


def mel(f: Column) -> Column:
    return 1127.0 * F.log1p(f / 700.0)


def next_power_of_two(n: Column) -> Column:
    """The smallest power of two of at least n, and at least 1."""
    bits = F.length(F.bin(F.greatest(n, F.lit(1)).cast("bigint") - 1))
    return F.when(n <= 1, F.lit(1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits))
