"""Text forms of pointers, links and arrays, for tables that other tools wrote."""

from __future__ import annotations

import csv
import hashlib
import os
import re
from urllib.parse import quote

Link = tuple[int, float, int, tuple[int, int]]


def pointer_text(p: tuple[int, int]) -> str:
    return f"({p[0]},{p[1]})"


def parse_pointer(text: str) -> tuple[int, int] | None:
    m = re.search(r"\(\s*(\d+)\s*,\s*(\d+)\s*\)", text)
    return (int(m[1]), int(m[2])) if m else None


def link_text(link: Link) -> str:
    arr, wgt, ctx, dst = link
    return f"({arr},{wgt:g},{ctx},{pointer_text(dst)})"


def parse_link(text: str) -> Link | None:
    """arr,wgt,ctx,class,cptr with any parentheses and quotes; None if a part is missing or no number."""
    parts = [x.strip() for x in re.sub(r"[()\"\\]", "", text).split(",")]
    try:
        return int(parts[0]), float(parts[1]), int(parts[2]), (int(parts[3]), int(parts[4]))
    except (IndexError, ValueError):
        return None


def parse_path(text: str) -> list[list[Link]]:
    """A path a line, its links parted by semicolons."""
    return [[x for x in map(parse_link, line.split(";")) if x] for line in text.splitlines() if line.strip()]


def parse_links(text: str) -> list[Link]:
    """{"(…)","(…)"}; up to two characters are no link."""
    if len(text) <= 2:
        return []
    return [x for x in map(parse_link, re.findall(r"\([^()]*(?:\([^()]*\))?[^()]*\)", text.strip("{}"))) if x]


def parse_array(text: str) -> list[str]:
    """{a,"b,c"} to its members."""
    inner = text.strip()[1:-1] if text.strip().startswith("{") else text.strip()
    return next(csv.reader([inner], escapechar="\\"), []) if inner else []


def string_array(items: list[str]) -> str:
    return "{" + ",".join('"' + x.replace('"', '\\"') + '"' for x in sorted(items)) + "}"


def int_array(items: list[int]) -> str:
    return "{" + ",".join(map(str, sorted(items))) + "}"


def pointer_array(items: list[tuple[int, int]]) -> str:
    return "{" + ",".join(f'"{pointer_text(p)}"' for p in items) + "}"


def link_array(items: list[Link]) -> str:
    return "{" + ",".join(f'"{link_text(x)}"' for x in items) + "}"


def parse_pointers(text: str) -> list[tuple[int, int]]:
    return [(int(a), int(b)) for a, b in re.findall(r"\(([0-9]+),([0-9]+)\)", text)]


def parse_appointment(text: str) -> dict | None:
    """(arr,sttype,chapter,{contexts},(class,cptr),{(class,cptr),…}) to its fields."""
    m = re.match(r"\s*\(?(\d+),(-?\d+),\"?([^,\"]*)\"?,\"?\{([^}]*)\}\"?,\"?(\([^)]*\))\"?,\"?\{(.*)\}\"?\)?\s*$", text)
    if not m:
        return None
    return {"arr": int(m[1]), "sttype": int(m[2]), "chapter": m[3], "contexts": [c.strip('" ') for c in m[4].split(",") if c.strip('" ')], "to": parse_pointer(m[5]), "from": parse_pointers(m[6])}


def text_of(items: list[str]) -> str:
    return ", ".join(items)


def items_of(text: str) -> tuple[list[str], int]:
    parts = text.split(",")
    return parts, sum(bool(x.strip()) for x in parts)


def frequencies(items: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for x in map(str.strip, items):
        out[x] = out.get(x, 0) + 1
    return out


def place(item: str, items: list[str]) -> tuple[int, bool]:
    return (items.index(item), True) if item in items else (-1, False)


# Cached assets

MAX_ASSET = 25 << 20
_TYPES = {"css": "text/css", "gif": "image/gif", "htm": "text/html", "html": "text/html", "jpeg": "image/jpeg", "jpg": "image/jpeg", "js": "application/javascript", "json": "application/json", "md": "text/markdown", "pdf": "application/pdf", "png": "image/png", "svg": "image/svg+xml", "txt": "text/plain", "webp": "image/webp"}


def safe(text: str, empty: str = "any") -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_") or empty


def asset_key(name: str) -> str:
    """Up to three words as they are, longer names by their first three words and a hash."""
    words = name.split()
    return safe(name) if len(words) <= 3 else f"{safe(' '.join(words[:3]))}_{hashlib.sha1(name.encode()).hexdigest()[:12]}"


def asset_folder(name: str, chapter: str, context: str | list[str] = "", root: str = ".") -> str:
    ctx = context if isinstance(context, str) else ",".join(context)
    return os.path.join(root, "assets", safe(chapter), safe(ctx.strip()), asset_key(name))


def asset_url(file: str, name: str, chapter: str, context: str = "", base: str = "/api/assets/file") -> str:
    return f"{base}?name={quote(name, safe='')}&chapter={quote(chapter, safe='')}&context={quote(context, safe='')}&file={quote(file, safe='')}"


def asset_filename(source: str, filename: str | None = None) -> str:
    stem, ext = os.path.splitext(os.path.basename(filename or source))
    return safe(stem, "asset") + ext.lower()


def content_type(path: str) -> str:
    return _TYPES.get(path.rpartition(".")[2].lower(), "application/octet-stream")


def attach_asset(data: bytes | str, name: str, chapter: str, context: str | list[str] = "", root: str = ".", filename: str | None = None) -> str:
    """Copies a file (by path or file:// address) or bytes to the asset's folder; larger than MAX_ASSET is an error."""
    if isinstance(data, str):
        source = data.removeprefix("file://")
        if re.match(r"[a-z]+://", source):
            raise ValueError(f"only local files can be attached here: {data}")
        filename = filename or source
        with open(source, "rb") as f:
            data = f.read(MAX_ASSET + 1)
    if len(data) > MAX_ASSET:
        raise ValueError(f"an asset may have {MAX_ASSET} bytes at most")
    folder = asset_folder(name, chapter, context, root)
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, asset_filename("asset.bin", filename))
    with open(path, "wb") as f:
        f.write(data)
    return path


def assets(name: str, chapter: str, context: str | list[str] = "", root: str = ".") -> list[str]:
    folder = asset_folder(name, chapter, context, root)
    return sorted(os.path.join(folder, f) for f in os.listdir(folder)) if os.path.isdir(folder) else []
