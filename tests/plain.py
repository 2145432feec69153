
import re
import unicodedata

from weftline.functions import lexicons as lex
from weftline.functions import text as t
from weftline.operators import planner

HEAD, CAPTION, DOT = lex.HEADING_MARK, lex.CAPTION_MARK, lex.BULLET_MARK
INLINE = [(re.compile(p), to.replace("$", "\\")) for p, to in t.INLINE]
BLOCKS = ((0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0xFE00, 0xFE0F), (0x200D, 0x200D), (0x2190, 0x21FF), (0x2300, 0x23FF), (0x24C2, 0x24C2))


def spaced(x):
    return re.sub(r"[^\S\n]+", " ", x).strip()


def inline(x):
    x = re.sub("(?s)<!--.*?-->", " ", x)
    for pattern, to in INLINE:
        x = pattern.sub(to, x)
    x = spaced(re.sub(r"(?<![(\w])https?://\S+", "", x))
    x = re.sub(r"([.,;:])\1+", r"\1", re.sub(r"\s+([.,;:!?])", r"\1", x))
    return re.sub(r"([.;:]),", r"\1", x).strip()


def undecorated(x):
    shown = lambda c: not any(a <= ord(c) <= b for a, b in BLOCKS) and (c == "™" or ord(c) <= 0x2000 or unicodedata.category(c) != "So") and c != "\ufeff"
    return "".join(filter(shown, x))


def cells_of(row):
    row = row.strip()
    return [inline(c) for c in row[row.startswith("|") : len(row) - row.endswith("|")].split("|")]


def is_separator(cells):
    filled = [c for c in cells if c.strip()]
    return bool(filled) and all(re.match(r"^:?-{2,}:?$", c.strip()) for c in filled)


def column(cell):
    name = inline(cell).rstrip(":").split(":")[0]
    return " ".join(spaced(undecorated(re.sub(r"\s*\([^)]*\)\s*", " ", name))).strip(" .:-").split()[:4])


def table_points(rows):
    head, *body = map(cells_of, rows) if rows else [[]]
    names = [column(c) for c in head]
    for row in body:
        full = [c for c in row if c]
        if not full or is_separator(row):
            continue
        if len(full) == 1:
            yield full[0]
            continue
        if len(head) <= 2:
            said = full[1:]
        else:
            said = []
            for i, value in enumerate(full[1:], 1):
                name, value = names[i] if i < len(names) else "", value.rstrip(" .,;:")
                if value and name.lower().strip() in lex.RATIONALE_COLUMNS:
                    said.append(value if i == 1 else "— " + value)
                elif value:
                    said.append(value if not name or name.lower().strip() in lex.GENERIC_COLUMNS else f"{name}: {value}")
        yield f"{full[0].rstrip(' .,;:')}: {'; '.join(said)}".strip()


def marked_lines(text):
    """The lines that the normaliser leaves, without blanks."""
    out, fence, table = [], "", []
    said = lambda x: bool(re.search("[A-Za-z0-9]", x))

    def flush():
        out.extend(DOT + p for p in table_points(table))
        table.clear()

    for raw in re.split("\r\n|\r|\n|\u2028", text or ""):
        ticks = re.match(r"^\s{0,3}(`{3,}|~{3,})", raw)
        if ticks or fence:
            flush()
            if ticks:
                fence = "" if fence == ticks[1][0] else fence or ticks[1][0]
            continue
        blank = not raw.strip() or re.match(r"^\s{0,3}(?:[-*_][ \t]*){3,}$", raw)
        if not blank and re.match(r"^\s*\|.*\|[ \t]*$", raw):
            table.append(raw)
            continue
        flush()
        if blank:
            continue
        shapes = ((r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", "head"), (r"^\s{0,3}(?:>\s?)+", "quote"), (r"^(\s*)(?:[-*+•▪◦‣⁃])\s+", "item"), (r"^\s*\d{1,3}[.)]\s+", "ordered"), ("^! ", "caption"), ("^## ", "head2"))
        m, kind = next(((m, k) for p, k in shapes if (m := re.match(p, raw))), (None, "prose"))
        body = m[2] if kind == "head" else raw[m.end() :] if m else raw
        x = inline(body)
        x = spaced(x) if kind == "caption" else spaced(undecorated(x))
        if kind.startswith("head"):
            x = x.strip(" .:-#")
        if said(x) or (kind == "caption" and x):
            out.append({"head": HEAD, "head2": HEAD, "item": DOT, "caption": CAPTION}.get(kind, "") + x)
    flush()
    return out


def bullet(x):
    return re.match(r"^\s*(?:[-*•‣▪●◦o>])\s+", x)


def numbered(x):
    m = re.match(r"^\s*(\d{1,2}|[ivxlc]+)[.)\]]\s*(.*)$", x)
    return m[2].strip() if m else None


def heads(line, after):
    """Whether a line is a heading, ``after`` being the raw next one or None."""
    n, rest = len(line.split()), numbered(line)
    if line.startswith(HEAD) or line.startswith(CAPTION) or bullet(line):
        return line.startswith(HEAD)
    if rest is not None:
        return len(rest.split()) <= 9 and not (rest.endswith(".") and len(rest.split()) > 5)
    low = line.lower().rstrip(".")
    strong = {low, low.split()[0].rstrip(".:,;") if low.split() else ""} & set(lex.STRONG_HEADINGS)
    leads = bool(after) and (len(after.split()) >= 4 or bool(bullet(after)))
    return bool(
        (line.isupper() and n <= 10 and len(line) <= 90) or (strong and n <= 12 and (n <= 5 or not line.endswith("."))) or line.startswith(("Section", "Chapter", "Part", "Module"))
        or (line.endswith(":") and n <= 8) or (n <= 10 and len(line) <= 90 and line[0].isupper() and line[-1] not in ".,;!?" and leads)
    )


def packed(paragraph, most=220):
    out = [""]
    for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])", re.sub(r"\s+", " ", paragraph).strip()):
        both = f"{out[-1]} {s}".strip()
        out = out[:-1] + [both] if len(both) <= most or not out[-1] else out + [s]
    return [s for s in out if s]


def bare(line):
    return line.replace(HEAD, "").strip()


def is_meta(line):
    return bool(re.match(lex.AUTHOR, bare(line)) or re.search(lex.DATE, bare(line)))


def people(lines):
    """(author, date): the first of each, a line that names the author lending no date."""
    author = date = None
    for x in map(bare, lines):
        if author is None:
            m = re.match(lex.AUTHOR, x)
            title = x and not bullet(x) and len(x.split()) <= 4 and len(x) <= 40 and re.search(r"(?i)(?:,|prof|dr|mr|mrs|ms|ph\.?d|md)\b", x) and re.fullmatch(r"[A-Za-z .'\-]+(?:,?\s+(?:PhD|MD|Prof|Dr|MSc|MA|BA|BSc))?", x) and not x.rstrip(".").isupper()
            if m or title:
                author = m[1].strip().strip(":") if m else x.rstrip(".")
                continue
        found = re.search(lex.DATE, x)
        if date is None and found:
            date = found[0].strip()
    return author, date


def structured(lines):
    """((title, subtitle, author, date), [(heading, type, points)]) of a document's marked lines."""
    lines = [x.strip() for x in lines]
    skip, zone = {i for i, x in enumerate(lines) if is_meta(x)}, lines[:12]
    short = lambda x: 2 <= len(x.split()) <= 16 and not x.endswith(".")
    at = next((i for i, x in enumerate(zone) if i not in skip and not bullet(x) and not x.startswith((CAPTION, HEAD)) and short(x) and x[0].isupper()), None)
    subtitle = None
    for i in range(at + 1, len(zone)) if at is not None else ():
        if i in skip or bullet(zone[i]):
            continue
        if heads(zone[i], zone[i + 1] if i + 1 < len(zone) else None):
            break
        if short(bare(zone[i])) and not heads(bare(zone[i]), None):
            subtitle = bare(zone[i])
            skip.add(i)
            break
    title = lines[at] if at is not None else "Presentation"
    skip.add(at)
    parts = [[None, [], []]]
    for i, x in enumerate(lines):
        if i in skip:
            continue
        rest = numbered(x)
        if heads(x, lines[i + 1] if i + 1 < len(lines) else None):
            parts.append([(re.sub(r"\s+", " ", rest).strip() if rest is not None else bare(x)).rstrip(".:"), [], []])
        elif x.startswith(CAPTION):
            parts[-1][2].append(spaced(x[len(CAPTION) :]))
        elif bullet(x):
            parts[-1][1].append(spaced(x[bullet(x).end() :]))
        elif rest is not None and not heads(x, None):
            parts[-1][1].append(spaced(rest))
        else:
            parts[-1][1] += packed(x)
    out = []
    for heading, points, captions in parts:
        points = [p for p in points + captions if p]
        kind = "practical" if re.search(rf"\b(?:{lex.PRACTICAL_SECTION})\b", " ".join([heading or "Overview", *points]).lower()) else "theory"
        if len(parts) == 1:
            heading, kind, points = "Key Concepts & Overview", "theory", points or ["Summary of the source content."]
        if points and (heading or "Overview") != title and heading != "":
            out.append((heading or "Overview", kind, points))
        elif points and heading == "" and title:
            out.append(("", kind, points))
    return (title, subtitle, *people(lines)), out


def words(x):
    return re.findall(r"[A-Za-z0-9][A-Za-z0-9'\-/&]*", x)


def squeezed(x):
    return re.sub(r"\s+", " ", x or "").strip()


def label(point):
    m = re.match(r"^([A-Z][A-Za-z0-9&/'\-]*(?:[ ][A-Za-z0-9&/'\-]+){0,5}):(?:\s|$)", point)
    name = squeezed(m[1]).strip(" .:-") if m else ""
    bad = not name or len(words(name)) > lex.TITLE_WORDS or name.lower() in lex.GENERIC_HEADINGS or re.match(lex.VARIANT_LABEL, name)
    return None if bad else name


def fit_title(x):
    x = squeezed(x).strip(" .:-#")
    if x.lower() in lex.GENERIC_HEADINGS or not words(x):
        return ""
    return x if len(words(x)) <= lex.TITLE_WORDS and len(x) <= 90 else " ".join(words(x)[: lex.TITLE_WORDS]).rstrip(" ,;:")


def split_point(point):
    """A long point as its clauses, short ones joined to the clause before."""
    held = []
    for c in re.split(planner.CLAUSE_CUT, point) if len(words(point)) > lex.MAX_WORDS else ():
        c = squeezed(c).lstrip(" ,;:.-–—")
        if c and held and len(words(c)) < lex.MIN_CLAUSE:
            held[-1] = f"{held[-1].rstrip(' ,;:')}, {c[0].lower()}{c[1:]}"
        elif c:
            held.append(c)
    if len(held) < 2:
        return [point]
    name, out = label(point), []
    for i, c in enumerate(held):
        c = (c if i == 0 or not name or label(c) else f"{name}: {c}").rstrip(" ,;:.")
        c += "" if c.endswith(("!", "?")) else "."
        out.append(c[0].upper() + c[1:])
    return out


def short(point):
    ends = [m.end() for m in re.finditer(r"[A-Za-z0-9]\S*", point)]
    if len(words(point)) <= lex.MAX_WORDS or len(ends) <= lex.MAX_WORDS:
        return point
    cut = ends[lex.MAX_WORDS - 1]
    head = point[:cut].rstrip(" ,;:-")
    at = next((p + len(m) - 1 for m in planner.CLAUSE_ENDS if (p := head.rfind(m)) > cut * 0.55), len(head))
    head = squeezed(head[:at]).rstrip(" ,;:-.")
    return (head + ("" if head.endswith(("!", "?")) else ".")) if head else squeezed(point[:cut])


def runs(points, parts):
    own, captions = [p for p in points if not re.match(lex.CAPTION, p)], [p for p in points if re.match(lex.CAPTION, p)]
    if parts <= 1:
        return [points]
    out, at = [], 0
    for i in range(parts):
        end = min(max(round((i + 1) * (len(own) / parts)), at + 1), len(own))
        out.append(own[at:end] + (captions if i == 0 else []))
        at = end
    return [r for r in out if r]


def slide_title(run, base):
    names = [x for x in map(label, run) if x]
    most = max(names, key=lambda x: (names.count(x), -names.index(x)), default=None)
    common = most and (names.count(most) >= 2 or len(run) == len(names) == 1)
    return (fit_title(most) if common else "") or fit_title(label(run[0]) or "") or base


def pool(atoms, target):
    """(title, subtitle, section, bullets) of the slides of one kind; atoms: (section, points)."""
    if target <= 0 or not atoms:
        return []
    held = []
    for section, points in atoms:
        points = [q for p in points for q in split_point(p)]
        cap = max(1, min(target, max(len(points) // lex.MIN_BULLETS, 1), lex.MAX_SLOTS))
        if held and len(points) < lex.MIN_BULLETS and len(held[-1][1]) + len(points) <= 2 * lex.MAX_BULLETS:
            held[-1] = [held[-1][0], held[-1][1] + points, 1]
        else:
            held.append([section, points, cap])
    by_size = sorted(range(len(held)), key=lambda i: (len(held[i][1]), i))
    small = sorted(by_size[: max(0, len(held) - target)])
    if small:
        host = by_size[len(small)]
        held[host] = [held[host][0], held[host][1] + [p for i in small for p in held[i][1]], 1]
        held = [a for i, a in enumerate(held) if i not in small]
    slots = [1] * len(held)
    for _ in range(target - len(held)):
        open_ = [i for i in range(len(held)) if slots[i] < held[i][2]]
        slots[max(open_ or range(len(held)), key=lambda i: (held[i][2] - slots[i] if open_ else 0, len(held[i][1]), -i))] += 1
    slides, spare = [], []
    for (section, points, _), n in zip(held, slots, strict=True):
        base, parts = fit_title(section), runs(points, n)
        for i, run in enumerate(parts):
            name = slide_title(run, base) or section or "Key Points"
            name = f"{base} — Part {i + 1}" if len(parts) > 1 and name == base and base else name
            lines = [short(p) for p in run]
            slides.append([name, section if section and re.sub(t.PART_SUFFIX, "", name) != section else "", section, lines[: lex.MAX_BULLETS]])
            spare += [(section, lines[k : k + lex.MAX_BULLETS]) for k in range(lex.MAX_BULLETS, len(lines), lex.MAX_BULLETS)]
    for section, lines in spare[: target - len(slides)]:
        name = fit_title(label(lines[0]) or "") or section or "Key Points"
        slides.append([name, section if section != name else "", section, lines])
    seen = set()
    for s in slides:
        stem, n = re.sub(t.PART_SUFFIX, "", s[0]), 2
        if s[0] in seen:
            while f"{stem} ({n})" in seen:
                n += 1
            s[0] = f"{stem} ({n})"
        seen.add(s[0])
    return slides


def planned(sections, target, theory):
    """(title, subtitle, section, type, bullets) of a deck's content slides; sections: (heading, type, points)."""
    atoms = {"theory": [], "practical": []}
    for heading, declared, points in sections:
        points = [p for p in map(squeezed, points) if p]
        of = lambda p: "practical" if re.search(rf"(?i)\b(?:{lex.PRACTICAL_POINT})\b", p) else "theory"
        kinds = {k: [p for p in points if of(p) == k] for k in atoms}
        if not kinds[declared]:
            kinds = {k: points if k == declared else [] for k in atoms}
        for k in atoms:
            if kinds[k]:
                atoms[k].append((squeezed(heading), kinds[k]))
    goals = {"theory": theory, "practical": target - theory} if all(atoms.values()) else dict.fromkeys(atoms, target)
    left = {k: [(s[0], s[1], s[2], k, s[3]) for s in pool(atoms[k], goals[k])] for k in atoms}
    wanted = {min(target - 1, round(i * (target / theory))) for i in range(theory)}
    out = []
    for at in range(target):
        kind = "theory" if at in wanted else "practical"
        kind = kind if left[kind] else "theory" if left["theory"] else "practical"
        if left[kind]:
            out.append(left[kind].pop(0))
    return out


def head_title(x):
    """Eight words of a title at most, its part marker apart."""
    x = squeezed(x).rstrip(".:;")
    m = re.search(t.PART_MARK, x)
    body = (x[: m.start()].strip().rstrip(".:;") if m else x).split()
    return " ".join([*body[:8], *([m[0].strip()] if m else [])]) if body else "Topic Overview"


def clipped(x):
    w = x.split()
    head = " ".join(w[: lex.MAX_WORDS])
    for marks, keep, cut in (((". ", "; ", " — "), 1, ""), ((", ",), 0, " ,;:")):
        at = max(map(head.rfind, marks))
        if len(w) > lex.MAX_WORDS and at > 0 and len(head[:at].split()) >= 10:
            return head[: at + keep].rstrip(cut or None) + "."
    return x


def refined(x):
    x = squeezed(re.sub(r"^[•\-*\s]+", "", x.strip())).capitalize()
    x = re.sub(r"(\.\s+)([a-z])", lambda m: m[1] + m[2].upper(), x)
    return clipped(x + ("" if x.endswith((".", "!", "?")) else ".")) if x else None


def recap_line(title, bullets):
    said = [b for b in bullets if b.strip() and not b.startswith("**")]
    line = refined(next((b for b in reversed(said) if not re.search(lex.GENERIC_TAKEAWAY, b)), said[-1] if said else "Key point covered in the session.")) or "Key information point."
    m = re.match(r"^([^:]{3,60}):\s+", line)
    line = line[m.end() :] if m and m[1].strip().lower() == title.strip().lower() else line
    if len(line) <= lex.RECAP_CHARS:
        return line
    stop = re.search(r"\.\s+(?=[A-Z])", line[: lex.RECAP_CHARS + 2])
    if stop:
        return line[: stop.start() + 1].rstrip()
    cut = next((c for m in ("; ", ", and ", ", which ", ", so ") if 0 < (c := line.find(m)) <= lex.RECAP_CHARS), None)
    return line[:cut].rstrip() + "." if cut else line[: lex.RECAP_CHARS - 1].rsplit(" ", 1)[0] + "..."


def deck(slides, request):
    """(title, subtitle, type, bullets) of a whole deck, in order, of planned slides and a request as a dict."""
    level, body = request["audience_level"], []
    known = level if level in lex.COVER_LINES else "Intermediate"
    for title, subtitle, _, kind, bullets in slides:
        if not any(b.strip() for b in bullets):
            continue
        lines = [r for b in bullets if b.strip() and (r := refined(b)) and r != "Key information point."]
        generic = lex.SUBTITLES[kind, known] if level in lex.COVER_LINES else {"practical": "Practical Implementation"}.get(kind, "Key Concepts")
        body.append((head_title(head_title(title)), squeezed(subtitle) or generic, kind, lines or list(lex.FILLERS[kind, known])))
    signed = [f"{a} {request[c]}" for a, c in (("Prepared by", "author_name"), ("Contact:", "author_email")) if request[c]]
    acts = ["**Opening**", f"1. {head_title(request['title'])}"]
    if body:
        acts += ["**Core Topics**", *(f"{i}. {b[0]} ({'Theory' if b[2] == 'theory' else 'Practice'})" for i, b in enumerate(body, 2))]
    acts += ["**Closing**", f"{len(body) + 2}. Key Takeaways & Next Steps"]
    pages = [acts[i : i + lex.OUTLINE_ROWS] for i in range(0, len(acts), lex.OUTLINE_ROWS)]
    for a, b in zip(pages, pages[1:]):
        if a[-1].startswith("**"):
            b.insert(0, a.pop())
    recap = {}
    for title, _, _, bullets in body:
        base = re.sub(t.PART_MARK, "", head_title(title)).strip()
        recap.setdefault(base, f"**{base}:** {recap_line(base, bullets)}")
    lines = list(recap.values()) or ["Summarize the most important ideas covered in this presentation."]
    if len(lines) > lex.RECAP_LINES:
        lines = [*lines[: lex.RECAP_LINES - 1], f"... and {len(lines) - lex.RECAP_LINES + 1} more key points"]
    outline = [("Presentation Outline" + (f" ({i}/{len(pages)})" if i > 1 else ""), None, "outline", p) for i, p in enumerate(pages, 1)]
    return [
        (head_title(request["title"]), request["subtitle"], "cover", [*lex.COVER_LINES[known], *signed]), *outline, *body,
        ("Key Takeaways", "Recap of the main ideas covered in this session", "takeaways", lines), ("Thank You", None, "end", ["Questions & discussion", *signed]),
    ]


def tokens(x):
    return {w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9\-]{2,}", x or "")} - set(lex.MATCH_STOPWORDS)


def section_key(x):
    x = re.sub(r"^\s*(?:\d+(?:\.\d+)*[.)]?|[IVXLC]+[.)])\s*", "", x or "")
    x = re.sub(r"\s*\([^)]*\)", "", re.sub(r"\s*[:–—-]\s*.*$", "", x))
    return " ".join(w for w in re.findall("[a-z0-9]+", x.lower()) if w not in lex.HEADING_NOISE)


def matched(slides, figures):
    """{slide: (figure, score)}: slides as (pos, title, bullets), figures as (no, caption, section)."""
    own = [(no, tokens(f"{caption} {section}"), section_key(section)) for no, caption, section in figures]
    best = []
    for pos, title, bullets in slides:
        said, key = tokens(" ".join([title, *(b for b in bullets if not b.startswith("**"))])), section_key(title)
        scored = []
        for no, f, k in own:
            shared = len(f & said)
            fits = shared and shared / len(f) >= 0.34 and (shared >= 2 or len(f) <= 2)
            score = shared / len(f) * min(shared, 4) ** 0.5 if fits else 0.0
            score += 0.0 if not k or not key else 2.0 if k == key else 1.6 if k.startswith(key) or key.startswith(k) else 0.0
            scored.append((score, -no))
        top = max(scored, default=(0.0, 0))
        if top[0] > 0:
            best.append((-top[0], pos, -top[1]))
    used, out = set(), {}
    for score, pos, no in sorted(best):
        if no not in used:
            used.add(no)
            out[pos] = (no, -score)
    return out
