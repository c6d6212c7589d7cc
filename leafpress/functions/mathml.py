"""Presentation MathML to TeX for one element: the only per-element Python code.

Used through an Arrow UDF on the few elements which carry no TeX of their own.
"""

from __future__ import annotations

from html.parser import HTMLParser

# Operators with a TeX name of their own.
OPERATORS = {
    "×": r"\times", "÷": r"\div", "±": r"\pm", "∓": r"\mp", "≤": r"\leq", "≥": r"\geq",
    "≠": r"\neq", "≈": r"\approx", "∞": r"\infty", "∑": r"\sum", "∏": r"\prod", "∫": r"\int",
    "√": r"\sqrt", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon",
    "π": r"\pi", "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu", "σ": r"\sigma", "φ": r"\phi",
    "ψ": r"\psi", "ω": r"\omega",
}

# TeX form by element; the number of arguments is that of the slots.
FORMS = {
    "msup": "{0}^{{{1}}}",
    "msub": "{0}_{{{1}}}",
    "msubsup": "{0}_{{{1}}}^{{{2}}}",
    "mfrac": r"\frac{{{0}}}{{{1}}}",
    "msqrt": r"\sqrt{{{0}}}",
    "mroot": r"\sqrt[{1}]{{{0}}}",
    "munder": r"\underset{{{1}}}{{{0}}}",
    "mover": r"\overset{{{1}}}{{{0}}}",
    "munderover": r"\overset{{{2}}}{{\underset{{{1}}}{{{0}}}}}",
}


#: Deeper elements are refused, as text counts for every open element.
MOST_DEPTH = 1000


class _Reader(HTMLParser):
    """Keeps, per open element, its name, text and the finished children."""

    def __init__(self):
        super().__init__()
        self.open = [["", [], []]]

    def handle_starttag(self, tag, attrs):
        if len(self.open) > MOST_DEPTH:
            raise ValueError(f"more than {MOST_DEPTH} elements within each other")
        self.open.append([tag, [], []])

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append((tag, ""))

    def handle_data(self, data):
        for element in self.open:
            element[1].append(data)

    def handle_endtag(self, tag):
        if any(e[0] == tag for e in self.open[1:]):
            while self._close() != tag:
                pass

    def _close(self):
        name, text, children = self.open.pop()
        self.open[-1][2].append((name, _tex(name, "".join(text), children)))
        return name


def _tex(name, text, children):
    """TeX of an element from its text and its children's (name, TeX)."""
    parts = [tex for _, tex in children]
    if name in ("mi", "mn"):
        return text
    if name == "mo":
        return OPERATORS.get(text, text)
    if name in FORMS:
        slots = 1 + max(i for i in range(3) if "{%d}" % i in FORMS[name])
        return FORMS[name].format(*parts) if len(parts) >= slots else ""
    if name == "mtable":
        rows = [tex for child, tex in children if child == "mtr"]
        return r"\begin{matrix} %s \end{matrix}" % r" \\ ".join(rows) if rows else ""
    if name == "mtr":
        return " & ".join(tex for child, tex in children if child == "mtd")
    return " ".join(parts) if parts or name == "mrow" else text


def mathml_to_tex(fragment: str | None) -> str | None:
    """TeX of a ``<math>`` element, NULL if it gives none."""
    if fragment is None:
        return None
    reader = _Reader()
    reader.feed(fragment)
    reader.close()
    while len(reader.open) > 1:
        reader._close()
    children = reader.open[0][2]
    return (children[0][1].strip() or None) if children else None
