"""Reading a tagged token stream piece by piece.

Tags may be cut anywhere between pieces.  From a ``<`` on, characters are held
back as long as they can still become a known tag; if they cannot, the held
characters, the last one included, are plain text.
"""

# fixed values: tag -> {state before: state after}; other states are unchanged
TAGS = {
    "</think>": {"thinking": "answer"},
    "</thinking>": {"thinking": "answer"},
    "<think>": {"answer": "thinking", "kb_query": "thinking"},
    "<thinking>": {"answer": "thinking", "kb_query": "thinking"},
    "<kb_query>": {"thinking": "kb_query"},
    "</kb_query>": {"kb_query": "thinking"},
}
_PREFIXES = {tag[:n] for tag in TAGS for n in range(1, len(tag))}


def split_piece(piece: str, mode: str, held: str):
    """([(mode, text), ...], mode, held) after one more piece of the stream."""
    out, text, i = [], [], 0

    def emit():
        if text:
            out.append((mode, "".join(text)))
            text.clear()

    while i < len(piece):
        if not held:
            j = piece.find("<", i)
            if j < 0:
                text.append(piece[i:])
                break
            text.append(piece[i:j])
            held, i = "<", j + 1
            continue
        held += piece[i]
        i += 1
        low = held.lower()
        if low in TAGS:
            emit()
            mode, held = TAGS[low].get(mode, mode), ""
        elif low not in _PREFIXES:
            text.append(held)
            held = ""
    emit()
    return [(m, t) for m, t in out if t], mode, held


class LiveSections:
    """Sections of an answer as its text arrives; a heading counts at the end of its line."""

    def __init__(self, line: str = "", titles=None):
        self.line, self.titles = line, list(titles or [])

    def push(self, text: str):
        """[(section number, title, added text), ...]"""
        added = []
        parts = text.split("\n")
        for n, part in enumerate(parts):
            self.line += part
            if part and self.titles:
                added.append((len(self.titles) - 1, self.titles[-1], part))
            if n < len(parts) - 1:
                heading = self.line.rstrip()
                body = heading[2:].lstrip() if heading.startswith("##") else ""
                if body and heading[2:3].isspace():
                    title = body.strip()
                    if title.lower() not in (t.lower() for t in self.titles):
                        self.titles.append(title)
                        added.append((len(self.titles) - 1, title, ""))
                self.line = ""
        return added
