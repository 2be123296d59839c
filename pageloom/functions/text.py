"""Text as column expressions."""

from __future__ import annotations

import functools
import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.columns import let
from pageloom.functions.metrics import BLANKS, stripped


def collapsed(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def normalised(c: Column) -> Column:
    """Collapsed, in lower case."""
    return F.lower(collapsed(c))


def slug(c: Column) -> Column:
    """Letters and digits joined by hyphens; "document" if there are none."""
    s = F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("document"))


def job_id(local_time: Column, name: Column) -> Column:
    return F.concat_ws("-", F.date_format(local_time, "yyyyMMdd-HHmmss"), slug(name))


def same_content(a: Column, b: Column) -> Column:
    """Equal, one within the other, or either empty, once normalised (F8)."""
    x, y = normalised(F.coalesce(a, F.lit(""))), normalised(F.coalesce(b, F.lit("")))
    return F.contains(x, y) | F.contains(y, x)


#: What counts as stuttering.
REPEATED = [r"([A-Za-z가-힣]{2,4})\1{4,}", r"(?U)\b([A-Za-z가-힣])(?:\s+\1){4,}\b", r"(?U)(\S)\1{9,}"]


def without_repeats(c: Column) -> Column:
    """Stuttering undone: fragments five times over, spaced letters five times, any character ten times (T5)."""
    for pattern in REPEATED:
        c = F.regexp_replace(c, pattern, "$1")
    return c


def detected_language(c: Column) -> Column:
    """By script: Hangul, then kana, then Han, else English."""
    return F.when(c.rlike("[가-힣]"), "ko").when(c.rlike("[぀-ヿ]"), "ja").when(c.rlike("[㐀-鿿]"), "zh").otherwise("en")


def font_family(name: Column, configured: str | None = None) -> Column:
    """A CSS family: the configured one, else the safe characters of the name, else sans-serif."""
    own = stripped(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9 _-]", ""))
    return F.lit(configured) if configured else F.coalesce(F.nullif(own, F.lit("")), F.lit("sans-serif"))


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_block(text: Column, family: Column, size: Column, line_height: Column, spacing: Column, glyphs: str = "[•◦▪●○■]") -> Column:
    """A styled block; special glyphs in spans of their own, lines broken."""
    said = F.regexp_replace(F.regexp_replace(escaped(text), f"({glyphs})", '<span class="glyph">$1</span>'), "\r\n|[\n\r]", "<br/>")
    css = F.concat_ws("; ", F.concat(F.lit("font-family: "), family), F.format_string("font-size: %.3fpt", size), F.format_string("line-height: %.3fpt", line_height), F.when(spacing.isNotNull(), F.format_string("letter-spacing: %.3fem", spacing)))
    return F.concat(F.lit('<div style="'), css, F.lit('">'), said, F.lit("</div>"))


#: Other names of providers.
PROVIDERS = {"local": "ctranslate2", "quickmt": "ctranslate2", "ct2": "ctranslate2", "remote": "openrouter"}


def provider(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """The name behind an alias, in lower case."""
    x = F.lower(stripped(c))
    out = x
    for k, v in (PROVIDERS if aliases is None else aliases).items():
        out = F.when(x == k, v).otherwise(out)
    return out


def truth(c: Column) -> Column:
    """Whether a setting's text means yes."""
    return F.coalesce(F.lower(stripped(c)).isin("1", "true", "yes", "on"), F.lit(False))


def layout_engine(c: Column) -> Column:
    x = F.lower(stripped(c))
    return F.when(x.isin("legacy", "pretext"), x).otherwise("legacy")


def clamped_page(page: Column, pages: Column) -> Column:
    return F.least(F.greatest(page, F.lit(1)), F.greatest(pages, F.lit(1)))


def page_label(page: Column, pages: Column) -> Column:
    return F.format_string("%d / %d", page, pages)


#: Networks that aren't publicly routed, and parts of them that are.
PRIVATE = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10"]
PUBLIC = ["192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]


_FOUR = r"(?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2})$"
#: How an IPv4 address stands among IPv6 ones.
_MAPPED = "00000000000000000000ffff"


def address(c: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, an IPv4 one as ::ffff:a.b.c.d; null if it is neither.  Texts in that form order as addresses do."""

    def octets(x: Column) -> Column:
        """The eight digits of the four decimal parts at the end of x; null if one is too large."""
        parts = F.transform(F.split(F.regexp_extract(x, f"({_FOUR})", 1), r"\."), lambda p: p.try_cast("int"))
        return let(parts, lambda o: F.when(F.forall(o, lambda v: v <= 255), F.lower(F.array_join(F.transform(o, lambda v: F.lpad(F.hex(v), 2, "0")), ""))))

    def colons(x: Column) -> Column:
        """With the four decimal parts, if there are, as two groups."""
        before = F.regexp_replace(x, _FOUR, "")
        return F.when(~F.contains(x, F.lit(".")), x).when(x.rlike(f":{_FOUR}"), let(octets(x), lambda o: F.concat(before, F.substring(o, 1, 4), F.lit(":"), F.substring(o, 5, 4))))

    def filled(halves: Column) -> Column:
        """All eight groups, the gap filled with zeros."""
        n, there = F.size(halves), F.size(F.flatten(halves))
        gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - there, F.lit(0)))
        return F.when((n == 1) & (there == 8), F.get(halves, 0)).when((n == 2) & (there <= 7), F.concat(F.get(halves, 0), gap, F.get(halves, 1)))

    halves = lambda y: F.transform(F.split(y, "::"), lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":")))
    digits = lambda a: F.when(F.forall(a, lambda h: h.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(a, lambda h: F.lpad(h, 4, "0")), ""))
    six = lambda x: let(colons(x), lambda y: let(halves(y), lambda h: let(filled(h), digits)))
    four = lambda x: F.concat(F.lit(_MAPPED), octets(x))
    # An IPv4 address, by far the commonest, takes the short way.
    return let(F.regexp_replace(F.lower(stripped(c)), r"%[^%:]+$", ""), lambda x: F.when(x.rlike(f"^{_FOUR}"), four(x)).when(F.contains(x, F.lit(":")), six(x)))


def _bounds(network: str) -> tuple[str, str]:
    """First and last address of a network, in digits."""
    n = ipaddress.ip_network(network)
    low, high = int(n.network_address), int(n.broadcast_address)
    mapped = (0xFFFF << 32) if n.version == 4 else 0
    return f"{low + mapped:032x}", f"{high + mapped:032x}"


def within(digits: Column, network: str) -> Column:
    """Whether an address (its digits) is in a network."""
    return digits.between(*_bounds(network))


def _any(digits: Column, networks: list[str]) -> Column:
    """Whether an address is in one of the networks; ranges that touch are one."""
    ranges: list[list[str]] = []
    for low, high in sorted(map(_bounds, networks)):
        if ranges and int(low, 16) <= int(ranges[-1][1], 16) + 1:
            ranges[-1][1] = max(ranges[-1][1], high)
        else:
            ranges.append([low, high])
    return F.coalesce(functools.reduce(lambda a, b: a | b, [digits.between(a, b) for a, b in ranges]), F.lit(False))


def public_ip(c: Column) -> Column:
    """Whether an address, IPv4 or IPv6, is publicly routed."""
    return let(address(c), lambda a: a.isNotNull() & (_any(a, PUBLIC) | ~_any(a, PRIVATE)))


def loopback(c: Column) -> Column:
    return let(address(c), lambda a: _any(a, ["127.0.0.0/8", "::1/128"]))


def client_ip(forwarded: Column, real: Column, peer: Column, public_only: bool = False) -> Column:
    """First (public) entry of the forwarding list, else the real address, else the peer."""
    entries = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), stripped), lambda x: (x != "") & (public_ip(x) if public_only else F.lit(True)))
    return F.coalesce(F.get(entries, 0), F.nullif(stripped(real), F.lit("")), peer)


def limited(ip: Column, enabled: bool = True) -> Column:
    """Whether a quota holds for this client: not for blank and local ones."""
    x = F.lower(stripped(F.coalesce(ip, F.lit(""))))
    return F.lit(enabled) & ~(x.isin("", "localhost") | loopback(x))


def stage(progress: Column) -> Column:
    """Stage named by a progress text."""
    x = F.lower(progress)
    return F.when(F.contains(x, F.lit("translat")), "translating").when(F.contains(x, F.lit("render")), "rendering").otherwise("parsing")


#: English messages by status; other languages are a caller's table.
MESSAGES = {"queued": "Waiting to start", "parsing": "Reading the document", "translating": "Translating the text", "rendering": "Laying out the pages", "succeeded": "Done", "failed": "The job failed", "quota_exceeded": "The daily limit is used up", "queue_busy": "Too many jobs are waiting"}


def message(status: Column, messages: dict[str, str] | None = None) -> Column:
    out = F.lit("")
    for k, v in (MESSAGES if messages is None else messages).items():
        out = F.when(status == k, v).otherwise(out)
    return out


def limit_text(used: Column, limit: Column, reset: Column) -> Column:
    return F.format_string("Daily limit reached: %.0f of %.0f s used; resets at %s", used, limit, F.date_format(reset, "yyyy-MM-dd HH:mm"))


def retry_detail(body: Column) -> Column:
    """The message inside an error's JSON, else its start."""
    return F.coalesce(F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.message"), F.substring(body, 1, 200))


def with_glossary(df: DataFrame, column: str, glossary: DataFrame, into: str) -> DataFrame:
    """``into``: collapsed text with the glossary's (ord, src, dst) replaced in order.

    A glossary is a short user-supplied table, at most 10,000 entries (more are an error): one row that is broadcast.
    """
    entry = F.struct("ord", "src", "dst")
    g = glossary.agg(F.array_sort(F.collect_list(entry)).alias("__entries"))
    g = g.select(F.when(F.size("__entries") > 10_000, F.raise_error(F.lit("a glossary holds at most 10,000 entries")).cast(g.schema["__entries"].dataType)).otherwise(F.col("__entries")).alias("__entries"))
    said = F.aggregate("__entries", collapsed(F.col(column)), lambda a, e: F.replace(a, e["src"], e["dst"]))
    return df.join(F.broadcast(g)).withColumn(into, said).drop("__entries")
