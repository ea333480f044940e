"""Links of pages as absolute addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sorrel.functions.text import let

_ADDRESS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
#: Ports that an address needn't name.
PORTS = {"http": "80", "https": "443"}


def parts(url: Column) -> Column:
    """struct<scheme, host, path, query, fragment> of an address or a part of one; what is missing is empty."""
    names = ("scheme", "host", "path", "query", "fragment")
    return F.struct(*[F.regexp_extract(url, _ADDRESS, k + 1).alias(n) for k, n in enumerate(names)])


def without_dots(path: Column) -> Column:
    """A path with its . and .. steps taken; it begins with a slash, and never climbs above the root."""
    none = F.expr("CAST(array() AS array<string>)")
    steps = F.split(F.regexp_replace(path, "^/", ""), "/")

    def step(taken: Column, x: Column) -> Column:
        return F.when(x == ".", taken).when(x == "..", F.slice(taken, F.lit(1), F.greatest(F.size(taken) - 1, F.lit(0)))).otherwise(F.concat(taken, F.array(x)))

    ends = F.element_at(steps, -1).isin(".", "..")
    taken = F.aggregate(F.when(ends, F.concat(steps, F.array(F.lit("")))).otherwise(steps), none, step)
    return F.concat(F.lit("/"), F.array_join(taken, "/"))


def encoded(text: Column, also: str) -> Column:
    """``text`` with spaces, marks in ``also`` and all that isn't ASCII as %XX; other characters stay."""
    odd = rf"[^\x21-\x7e]|[{also}]"
    one = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(c.rlike(odd), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.when(text.rlike(odd), F.array_join(one, "")).otherwise(text)


def resolve(raw: Column, base: Column) -> Column:
    """A link as an absolute http(s) address, taken against the address of its page: by scheme, host, path or query as far as it states them.

    Dots in paths are walked, backslashes are slashes, hosts and schemes are lower case, usual ports go, white
    space around and line ends within go, and what an address can't hold is written as %XX. Null for other
    schemes and without a host.
    """
    clean = F.regexp_replace(F.trim(F.regexp_replace(raw, r"[\t\r\n]", "")), r"\\", "/")

    def joined(p: Column) -> Column:
        r, b = p["r"], p["b"]
        own_scheme, own_host = r["scheme"] != "", r["host"] != ""
        scheme = F.lower(F.when(own_scheme, r["scheme"]).otherwise(b["scheme"]))
        host = F.when(own_scheme | own_host, r["host"]).otherwise(b["host"])
        folder = F.regexp_replace(b["path"], "[^/]*$", "")
        path = F.when(own_scheme | own_host | r["path"].startswith("/"), r["path"]).when(r["path"] == "", b["path"]).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), r["path"]))
        query = F.when(own_scheme | own_host | (r["path"] != "") | (r["query"] != ""), r["query"]).otherwise(b["query"])
        plain_host = F.lower(host)
        for name, port in PORTS.items():
            plain_host = F.when(scheme == name, F.regexp_replace(plain_host, f":({port})?$", "")).otherwise(plain_host)
        out = F.concat(scheme, F.lit("://"), plain_host, encoded(without_dots(path), '"<>`{}'), encoded(query, "\"<>'"), encoded(r["fragment"], '"<>`'))
        return F.when(scheme.isin(*PORTS) & (host != ""), out)

    return let(F.struct(parts(clean).alias("r"), parts(F.trim(base)).alias("b")), joined)
