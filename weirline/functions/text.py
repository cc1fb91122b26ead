"""Time layouts, templates and interpolation, agents, addresses and escapes as columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import message as M

#: Named time layouts as Spark patterns, tried in this order if a layout fails.
LAYOUTS = {
    "ANSIC": "EEE MMM d HH:mm:ss yyyy",
    "UnixDate": "EEE MMM d HH:mm:ss zzz yyyy",
    "RubyDate": "EEE MMM dd HH:mm:ss Z yyyy",
    "RFC822": "dd MMM yy HH:mm zzz",
    "RFC822Z": "dd MMM yy HH:mm Z",
    "RFC850": "EEEE, dd-MMM-yy HH:mm:ss zzz",
    "RFC1123": "EEE, dd MMM yyyy HH:mm:ss zzz",
    "RFC1123Z": "EEE, dd MMM yyyy HH:mm:ss Z",
    "RFC3339": "yyyy-MM-dd'T'HH:mm:ssXXX",
    "RFC3339Nano": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX",
    "Kitchen": "h:mma",
    "Stamp": "MMM d HH:mm:ss",
    "StampMilli": "MMM d HH:mm:ss.SSS",
    "StampMicro": "MMM d HH:mm:ss.SSSSSS",
    "StampNano": "MMM d HH:mm:ss.SSSSSSSSS",
}
#: Digits after the unit of each epoch layout down to nanoseconds.
EPOCHS = {"Epoch": 9, "EpochMilli": 6, "EpochMicro": 3, "EpochNano": 0}
#: Strftime conversions as Spark patterns.
STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "z": "Z", "Z": "zzz", "T": "HH:mm:ss", "D": "MM/dd/yy", "F": "yyyy-MM-dd", "R": "HH:mm", "%": "%"}


def strftime(layout: str) -> str:
    """A strftime layout as a Spark pattern."""
    out = []
    for literal, code in re.findall(r"([^%]+)|%(.)", layout):
        if literal:
            out.append(re.sub(r"[A-Za-z\[\]{}#]+", lambda m: f"'{m[0]}'", literal.replace("'", "''")))
        else:
            out.append(STRFTIME[code])
    return "".join(out)


def epoch(value: Column, layout: str) -> Column:
    """A decimal number of the layout's unit as nanoseconds, exactly: scaled as text, cut beyond them; null if unreadable or negative."""
    digits = EPOCHS[layout]
    pattern = r"^([0-9]+)(?:\.([0-9]*))?$"
    fraction = F.substring(F.rpad(F.regexp_extract(value, pattern, 2), 9, "0"), 1, digits) if digits else F.lit("")
    return F.when(value.rlike(pattern), F.concat(F.regexp_extract(value, pattern, 1), fraction).try_cast("bigint"))


def timestamp(value: Column, layout: str, tz: str | None = None, *, fallback: bool = True, year: Column | None = None) -> Column:
    """Nanoseconds of a time in a named, epoch or Spark layout, else in the first named layout that fits.

    Without a zone of its own the time is in tz (UTC by default); without a
    year it is in `year`, the current one by default.
    """
    if layout in EPOCHS:
        return epoch(value, layout)
    tried = [LAYOUTS.get(layout, layout), *(LAYOUTS.values() if fallback else ())]
    now = F.year(F.current_date()) if year is None else year

    def one(pattern: str) -> Column:
        bare = re.sub(r"'[^']*'", "", pattern)
        text, shape = value, pattern
        if m := re.match(r"E+,? ", shape):  # Spark does not parse weekdays, which add nothing
            text, shape = F.regexp_replace(text, r"^[A-Za-z]+,? ", ""), shape[m.end() :]
        if "MMM d " in shape:  # a day of one digit has a second space before it
            text = F.regexp_replace(text, " +", " ")
        if "y" not in bare:
            text, shape = F.concat(now.cast("string"), F.lit(" "), text), "yyyy " + shape
        if not re.search("[zZXVO]", bare):
            text, shape = F.concat(text, F.lit(" UTC")), shape + " VV"
            read = F.try_to_timestamp(text, F.lit(shape))
            return F.to_utc_timestamp(read, tz) if tz else read
        return F.try_to_timestamp(text, F.lit(shape))

    made = [one(p) for p in tried if p != "h:mma"]
    return F.unix_micros(F.coalesce(*made) if len(made) > 1 else made[0]) * 1000


def severity(value: Column, words: Mapping[str, int] | None = None) -> Column:
    """A severity by its word, else by its number."""
    number = F.when(value.rlike(r"^-?[0-9]+$"), value).try_cast("int")
    if not words:
        return number
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), value), number)


def template(text: str, names: Mapping[str, Column]) -> Column:
    """%name% replaced by the named column; an unknown name or a null becomes <name>."""
    parts = []
    for literal, name in re.findall(r"((?:(?!%\w+%).)+)|%(\w+)%", text, re.S):
        parts.append(F.lit(literal) if literal else F.coalesce(names[name].cast("string"), F.lit(f"<{name}>")) if name in names else F.lit(f"<{name}>"))
    return F.concat(*parts) if parts else F.lit("")


def interpolate(text: str, *, now: Column | None = None) -> Column:
    """%{name} replaced by an envelope column, else by the first value of that field, else by the
    time in that strftime layout (the message's, or now), else left as it is."""
    envelope = {"Type": "type", "Logger": "logger", "Hostname": "hostname", "Payload": "payload", "EnvVersion": "env_version", "Pid": "pid", "Severity": "severity"}
    parts = []
    for literal, name in re.findall(r"((?:(?!%\{[^}]*\}).)+)|%\{([^}]*)\}", text, re.S):
        if literal:
            parts.append(F.lit(literal))
        elif name in envelope:
            parts.append(F.col(envelope[name]).cast("string"))
        elif name == "UUID":
            parts.append(M.uuid_text())
        else:
            stamp = now if now is not None else F.timestamp_micros(F.expr("timestamp div 1000"))
            last = F.date_format(stamp, strftime(name)) if "%" in name and re.fullmatch(r"(?:[^%]|%[YymdeHIMSpbBaAjzZTDFR%])*", name) else F.lit("%{" + name + "}")
            parts.append(F.when(M.find(name).isNotNull(), M.text(name)).otherwise(last))
    return F.concat(*parts) if parts else F.lit("")


def json_escaped(text: Column) -> Column:
    """A JSON string's inside where quotes, backslashes and controls are all \\u escapes."""
    out = text
    for code in [0x5C, 0x22, *range(0x20)]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return out


#: Browsers by the pattern of their version, and systems by a word of the agent, in order.
BROWSERS = [("Opera", r"Opera[/ ](\d+)"), ("Chrome", r"Chrome/(\d+)"), ("Firefox", r"Firefox/(\d+)"), ("MSIE", r"MSIE (\d+)"), ("Safari", r"Version/(\d+)[^ ]* (?:Mobile/\S+ )?Safari")]
SYSTEMS = [("iPod", "iPod"), ("iPad", "iPad"), ("iPhone", "iPhone"), ("Android", "Android"), ("FirefoxOS", r"\(Mobile;|\(Tablet;"), ("Windows NT", "Windows"), ("Macintosh", "Macintosh"), ("Linux", "Linux"), ("BlackBerry", "BlackBerry")]


def agent(text: Column) -> tuple[Column, Column, Column]:
    """(browser, version, system) of a user agent, null where unknown."""
    browser, version, system = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for name, pattern in BROWSERS:
        browser, version = browser.when(text.rlike(pattern), F.lit(name)), version.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))
    for name, pattern in SYSTEMS:
        system = system.when(text.rlike(pattern if pattern.startswith(r"\(") else name), F.lit(name.split()[0]))
    return browser, version.try_cast("double"), system


def ipv4(text: Column) -> Column:
    """A dotted address as a number, null if it is none."""
    parts = F.split(text, r"\.")
    part = lambda k: F.get(parts, F.lit(k)).try_cast("bigint")
    good = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(good, part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


#: Months and weekdays by name, for sorting log files.
NAMES = {n.lower(): i + 1 for group in (["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"], ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]) for i, full in enumerate(group) for n in (full, full[:3])}


def file_keys(path: Column, pattern: str, names: Sequence[str], translation: Mapping[str, Mapping[str, int]] | None = None) -> dict[str, Column]:
    """A sort key for each named group of the pattern: its translation, its number, a month's or day's place, else -1."""
    order = {m: i + 1 for i, m in enumerate(re.findall(r"\(\?P?<(\w+)>", pattern))}
    java = pattern.replace("(?P<", "(?<")
    out = {}
    for name in names:
        text = F.regexp_extract(path, java, order[name])
        given = (translation or {}).get(name, {})
        words = {k.lower(): v for k, v in given.items() if k != "missing"} | ({} if given else NAMES)
        known = F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), F.lower(text)) if words else F.lit(None).cast("int")
        out[name] = F.when(text == "", F.lit(given.get("missing", -1))).otherwise(F.coalesce(known, text.try_cast("int"), F.lit(-1)))
    return out


def stream_name(path: Column, pattern: str, differentiator: Sequence[str]) -> Column:
    """The stream a log file belongs to: its differentiator, where names of groups stand for what they matched."""
    order = {m: i + 1 for i, m in enumerate(re.findall(r"\(\?P?<(\w+)>", pattern))}
    return F.concat(*[F.regexp_extract(path, pattern.replace("(?P<", "(?<"), order[d]) if d in order else F.lit(d) for d in differentiator])
