"""Which addresses may be fetched from."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from creativeaudit import constants as C
from creativeaudit.functions.text import trim_space

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and hand it to ``use``, which may mention it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _v4_number(quad: Column) -> Column:
    return F.aggregate(F.split(quad, r"\."), F.lit(0).cast("bigint"),
                       lambda acc, octet: acc * 256 + F.coalesce(octet.try_cast("bigint"), F.lit(0)))


def _v4_public(quad: Column) -> Column:
    def judge(n: Column) -> Column:
        def inside(cidr: str) -> Column:
            net = ipaddress.ip_network(cidr)
            return n.between(int(net.network_address), int(net.broadcast_address))

        return ~_any([inside(x) for x in C.BLOCKED_V4]) | _any([inside(x) for x in C.ALLOWED_V4])

    return _bind(_v4_number(quad), judge)


def _v6_hex(address: Column) -> Column:
    """An IPv6 address as 32 hex digits, or NULL if malformed."""
    def tail_as_hex(a: Column) -> Column:
        # A trailing dotted quad stands for the last two groups.
        quad = F.regexp_extract(a, f":({_QUAD})$", 1)
        as_hex = _bind(_v4_number(quad), lambda n: F.concat(
            F.lower(F.hex(F.floor(n / 65536))), F.lit(":"), F.lower(F.hex(n % 65536))))
        return F.when(quad != "", F.concat(F.regexp_replace(a, f"{_QUAD}$", ""), as_hex)).otherwise(a)

    def groups(text: Column) -> Column:
        return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
            F.split(text, ":", -1))

    def fill(halves: Column) -> Column:
        pair = F.struct(groups(F.get(halves, F.lit(0))).alias("l"), groups(F.get(halves, F.lit(1))).alias("r"))

        def join(p: Column) -> Column:
            missing = F.lit(8) - F.size(p["l"]) - F.size(p["r"])
            return (F.when(F.size(halves) == 1, p["l"]).when(
                (F.size(halves) == 2) & (missing > 0), F.concat(p["l"], F.array_repeat(F.lit("0"), missing), p["r"])))

        return _bind(pair, join)

    plain = F.lower(F.regexp_replace(address, "%.+$", ""))
    full = _bind(F.split(_bind(plain, tail_as_hex), "::", -1), fill)
    return _bind(full, lambda g: F.when(
        (F.size(g) == 8) & F.forall(g, lambda x: x.rlike(r"^[0-9a-f]{1,4}\z")),
        F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")))


def _v6_public(address: Column) -> Column:
    def judge(hex32: Column) -> Column:
        def inside(cidr: str) -> Column:
            # Fixed-width hex sorts like the number, so a network is a string range.
            net = ipaddress.ip_network(cidr)
            return hex32.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}")

        mapped = F.substring(hex32, 1, 24) == "0" * 20 + "ffff"
        quad = F.concat_ws(".", *[F.conv(F.substring(hex32, 25 + 2 * i, 2), 16, 10) for i in range(4)])
        plain = ~_any([inside(x) for x in C.BLOCKED_V6]) | _any([inside(x) for x in C.ALLOWED_V6])
        # An IPv4-mapped address is judged as the IPv4 address it carries.
        return F.coalesce(F.when(mapped, _v4_public(quad)).otherwise(plain), F.lit(False))

    return _bind(_v6_hex(address), judge)


def is_public_address(address: Column) -> Column:
    """True only for a well-formed, publicly routable address."""
    return (
        F.when(address.rlike(rf"^{_QUAD}\z"), _v4_public(address))
        .when(address.contains(":"), _v6_public(address))
        .otherwise(F.lit(False))
    )


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_host(url: Column) -> Column:
    """Host without credentials, port or brackets; '' when there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host_port = F.regexp_replace(authority, "^.*@", "")
    bracketed = F.regexp_extract(host_port, r"^\[([^\]]*)\]", 1)
    # A trailing dot names the same host.
    return F.lower(F.when(bracketed != "", bracketed)
                   .otherwise(F.regexp_replace(F.regexp_replace(host_port, ":.*$", ""), r"\.\z", "")))


def looks_like_literal_ip(host: Column) -> Column:
    # Labels of digits, also octal or hexadecimal ones, are numeric host forms ("127.1", "0x7f.0.0.1", "2130706433").
    return host.contains(":") | host.rlike(r"^(0x[0-9a-f]*|[0-9]+)(\.(0x[0-9a-f]*|[0-9]+))*\z")


def url_allowed(url: Column, addresses: Column | None = None) -> Column:
    """P5: scheme, host and every resolved address must be acceptable.

    What isn't resolved is refused: a NULL or empty list, and without a list of
    addresses every host that isn't itself a public address.
    """
    scheme, host = url_scheme(url), url_host(url)
    ok = scheme.isin("http", "https") & (host != "")
    if addresses is None:
        return F.coalesce(ok & is_public_address(host), F.lit(False))
    ok = ok & (~looks_like_literal_ip(host) | is_public_address(host))
    ok = ok & (F.size(addresses) > 0) & F.forall(addresses, lambda a: is_public_address(trim_space(a)))
    return F.coalesce(ok, F.lit(False))
