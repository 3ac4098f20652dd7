"""A bidirectional LSTM in numpy that labels each block of a page as main text or not.

It reads the whole sequence of blocks from both ends.  It is trained here, on pages that
``example`` makes from a seed, with labels that follow from how a page is put together.
The weights lie beside this file; ``python -m glossweave.llm.block_labeller`` trains them
anew and writes them there.
"""

from __future__ import annotations

import random
from functools import lru_cache
from pathlib import Path

import numpy as np

from glossweave.llm.html_blocks import WIDTH, blocks, features

HIDDEN, PAGES, EPOCHS, BATCH, RATE = 32, 3000, 5, 20, 0.01
MARK = ""

#: Names that page makers give to parts.
NAMES = {
    "menu": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "links", "main-menu", "top-bar"],
    "header": ["header", "masthead", "top", "branding", "site-header", "logo", "page-header", "site-branding", "top-bar"],
    "footer": ["footer", "bottom", "colophon", "site-footer", "copyright", "legal", "contentinfo", "disclaimer"],
    "side": ["sidebar", "aside", "widget", "related", "right-column", "trending", "popular", "more-stories", "recommended", "tags", "complementary", "secondary", "see-also", "promo-box"],
    "notice": ["cookie", "cookie-notice", "consent", "alert", "notice", "gdpr", "popup", "newsletter", "subscribe", "paywall", "modal", "privacy", "message", "alert alert-info", "warning", "site-notice", "announcement", "banner"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "sponsor", "ad-container", "adbox", "google-ads", "native-ad"],
    "form": ["search", "login", "signup", "contact-form", "subscribe-form"],
    "share": ["share", "social", "toolbar", "share-buttons"],
    "comments": ["comments", "comment", "comment-list", "discussion", "replies", "respond", "user-comments", "reactions", "comments-area", "feedback"],
    "main": ["content", "article", "post", "entry", "entry-content", "story", "main", "article-body", "post-body", "text", "page", "body"],
}
TAGS = {"menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "footer", "div"], "side": ["aside", "aside", "div", "section"], "notice": ["div", "div", "section", "p", "aside"], "ad": ["div", "div", "aside", "p", "section"], "form": ["form"], "share": ["div", "ul"], "comments": ["section", "div", "div", "ul", "ol"], "main": ["article", "article", "main", "div", "section", "td"]}
SAID = {
    "menu": "Home News About Contact Products Blog Help Start Sport World Archive".split(),
    "footer": ["© 2021 All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Contact us", "Powered by a server", "© {w} · {s}"],
    "notice": ["We use cookies to improve your experience.", "Accept all", "By continuing you agree to our terms.", "Sign up for our newsletter and never miss a story.", "This site uses cookies. {s}", "{s}"],
    "ad": ["Advertisement", "Sponsored", "Buy now and save {n} percent!", "{s}", "{s}", "{s} {s}", "{w} {w} {w}"],
    "form": ["Search", "Your email", "Password", "Log in", "Submit", "Name"],
    "share": ["Share", "Tweet", "Email this", "Print", "{n} shares"],
}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        parts = self.r.choice(["the an re tion er ing on st wh ea or th he in and".split(), "le que en eau ç é tion ment re la ou ai".split(), "der sch ung en keit ü ß ein ver be".split(), "ción ll rr os as que de ñ mente".split(), "ba ko mi re su ta no li".split()])
        self.parts, self.styled = parts, self.r.random() < 0.85

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(self.parts) for _ in range(r.choice([1, 1, 2, 2, 3, 4])))

    def sentence(self) -> str:
        r = self.r
        n = r.choice([1, 3, 6, 10, 15, 20])
        junk = r.choice([""] * 9 + ["%%%", "!!", " |", "&amp;&amp;"])
        words = [self.word()] * n if r.random() < 0.04 else [self.word() for _ in range(n)]
        if r.random() < 0.08:
            words[r.randrange(n)] = r.choice([f"{r.getrandbits(64):x}", f'token = "{r.getrandbits(128):x}"', str(r.getrandbits(50)), f"{r.randint(1, 255)}.{r.randint(1, 255)}.9.9", f"{self.word()}.{r.randint(1, 99)}@mail.example.com"])
        text = " ".join(x + junk for x in words) + r.choice([".", ".", ".", "!", "?", ""])
        return text.upper() if r.random() < 0.04 else text.capitalize()

    def prose(self) -> str:
        if self.r.random() < 0.05:
            return " ".join([self.word().capitalize()] * self.r.choice([10, 40, 200]))
        return " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 5, 8, 14])))

    def filled(self, kind: str) -> str:
        r = self.r
        return r.choice(SAID[kind]).replace("{w}", self.word()).replace("{s}", self.sentence()).replace("{n}", str(r.randint(1, 99)))

    def wrapped(self, kind: str, inside: str) -> str:
        r, tag = self.r, self.r.choice(TAGS[kind])
        plain = tag in ("div", "p", "td", "ul", "ol", "section")
        name = ""
        if (plain and self.styled) or r.random() < 0.4:
            end = r.choice([""] * 6 + ["-container", "-wrapper", "-box", "-inner", "-area", "-section", "s", "1"])
            name = f' {r.choice(["class", "class", "class", "id", "id", "role"])}="{" ".join([r.choice(NAMES[kind]) + end, *[self.word() for _ in range(r.randint(0, 1))]])}"'
        return f"<{tag}{name}>{inside}</{tag}>"

    def listed(self, kind: str) -> str:
        r = self.r
        items = [r.choice(SAID["menu"]) if kind == "menu" and r.random() < 0.5 else " ".join(self.word() for _ in range(r.randint(1, 3 if kind == "menu" else 9))) for _ in range(r.randint(2, 9))]
        if r.random() < 0.75:
            return "<ul>" + "".join(f'<li><a href="/{i}">{x}</a></li>' for i, x in enumerate(items)) + "</ul>"
        return r.choice([" ", " | ", " · "]).join(f'<a href="/{i}">{x}</a>' for i, x in enumerate(items))

    def part(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            return self.wrapped(kind, self.listed("menu"))
        if kind == "header":
            inside = r.choice([f"<h1>{self.word()}</h1>", f"<div>{self.word()}</div>", f"<a href='/'>{self.sentence()}</a>", f"<p>{self.sentence()}</p>", ""]) + (self.part("menu") if r.random() < 0.6 else "")
            return self.wrapped(kind, inside)
        if kind == "side":
            return self.wrapped(kind, r.choice([f"<h3>{self.sentence()}</h3>", ""]) + "".join(r.choice([self.listed("side"), f"<p>{self.sentence()}</p>", f"<p>{self.prose()}</p>"]) for _ in range(r.randint(1, 3))))
        if kind == "form":
            return self.wrapped(kind, "".join(f"<label>{self.filled('form')}</label><input>" for _ in range(r.randint(0, 3))) + f"<button>{self.filled('form')}</button>" + r.choice(["", f"<p>{self.sentence()}</p>"]))
        if kind == "comments":
            inner = r.choice(["p", "div", "li"])
            items = "".join(f"<{inner}>{r.choice(['', f'<b>{self.word()}</b> '])}{self.prose()}</{inner}>" + r.choice(["", "<a href='#'>Reply</a>"]) for _ in range(r.randint(1, 6)))
            return self.wrapped(kind, r.choice(["<h2>Comments</h2>", f"<h3>{r.randint(1, 40)} comments</h3>", ""]) + items)
        inside = "".join(r.choice(["{}", "<p>{}</p>", "<span>{}</span> ", "<a href='#'>{}</a> ", "<button>{}</button>" if kind == "notice" else "<p>{}</p>"]).format(self.filled(kind)) for _ in range(r.randint(1, 3 if kind != "footer" else 5)))
        return self.wrapped(kind, inside)

    def kept(self) -> str:
        r, text = self.r, MARK + self.prose()
        if r.random() < 0.25:
            words = text.split(" ")
            i = r.randrange(len(words))
            words[i] = r.choice(["<a href='/x'>{}</a>", "<b>{}</b>", "<em>{}</em>", "<span>{}</span>"]).format(words[i])
            text = " ".join(words)
        named = f"<div class='{r.choice(['para', 'paragraph', 'text', 'p', 'body-text', 'headline', 'summary', 'lead', self.word()])}'>{{}}</div>"
        return r.choice(["<p>{}</p>"] * 8 + [named, "<p>{}", "<p><b>{}<br>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<h3>{}</h3>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<section><p>{}</p></section>"]).format(text)

    def page(self) -> str:
        r, some = self.r, lambda p, kind: self.part(kind) if self.r.random() < p else ""
        title = r.choice([f"<h1>{MARK}{self.sentence()}</h1>", f"<header><h1>{MARK}{self.sentence()}</h1></header>" if r.random() < 0.3 else f"<h1>{MARK}{self.sentence()}</h1>", f"<h2>{MARK}{self.sentence()}</h2>", ""])
        body = [self.kept() for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20]))]
        if r.random() < 0.15:
            body += [body[-1]] * r.randint(1, 12)
        if r.random() < 0.15:
            body = [f"<p>{MARK}{self.sentence()}</p>" for _ in body]
        for p, kind in ((0.18, "ad"), (0.1, "side"), (0.08, "share"), (0.06, "form"), (0.1, "notice")):
            if r.random() < p:
                body.insert(r.randint(0, len(body)), self.part(kind))
        main = self.wrapped("main", title + "".join(body) + some(0.12, "share") + some(0.08, "comments"))
        for _ in range(r.choice([0, 0, 1, 2])):
            main = f"<div{r.choice(['', ' class=wrapper', ' id=page', ' class=container', ' class=row'])}>{main}</div>"
        top = "".join(r.sample([some(0.4, "notice"), some(0.5, "header"), some(0.6, "menu"), some(0.4, "ad"), some(0.2, "form"), some(0.15, "side")], 6))
        low = "".join(r.sample([some(0.35, "side"), some(0.2, "ad"), some(0.3, "comments"), some(0.15, "form"), some(0.1, "share"), some(0.1, "menu")], 6)) + some(0.75, "footer") + some(0.1, "notice")
        return f"<html><head><title>{self.sentence()}</title></head><body>{top}{main}{low}" + r.choice(["</body></html>", ""])


def example(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a made page."""
    found = blocks(_Maker(seed).page())
    keep = np.array([MARK in b.text for b in found], np.float32)
    for b in found:
        b.text = b.text.replace(MARK, "") or "-"
    return features(found), keep


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(seed: int) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    w = {"out": g.normal(0, 0.2, (2 * HIDDEN, 1)), "out_b": np.zeros(1)}
    for d in "fb":
        w[d + "x"] = g.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * HIDDEN))
        w[d + "h"] = g.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w[d + "_b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {k: v.astype(np.float32) for k, v in w.items()}


def _run(w: dict, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of one direction, (time, batch, HIDDEN), and what the way back needs."""
    t, b, _ = x.shape
    z = x @ w[d + "x"] + w[d + "_b"]
    h = c = np.zeros((b, HIDDEN), np.float32)
    out, kept = np.empty((t, b, HIDDEN), np.float32), [None] * t
    for i in range(t) if d == "f" else range(t - 1, -1, -1):
        a = z[i] + h @ w[d + "h"]
        gate, g = _sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
        new_c = gate[:, HIDDEN : 2 * HIDDEN] * c + gate[:, :HIDDEN] * g
        tc = np.tanh(new_c)
        m = mask[i][:, None]
        kept[i] = (h, c, gate, g, tc, m)
        h, c = m * gate[:, 2 * HIDDEN :] * tc + (1 - m) * h, m * new_c + (1 - m) * c
        out[i] = h
    return out, kept


def forward(w: dict, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    f, kf = _run(w, "f", x, mask)
    b, kb = _run(w, "b", x, mask)
    both = np.concatenate([f, b], axis=2)
    return _sigmoid(both @ w["out"] + w["out_b"])[..., 0], (both, kf, kb)


def gradients(w: dict, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
    p, (both, kf, kb) = forward(w, x, mask)
    n = mask.sum()
    loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
    dz = ((p - y) * mask / n)[..., None].astype(np.float32)
    out = {"out": np.einsum("tbh,tbo->ho", both, dz), "out_b": dz.sum((0, 1))}
    dboth = dz @ w["out"].T
    for d, kept, dh_all in (("f", kf, dboth[..., :HIDDEN]), ("b", kb, dboth[..., HIDDEN:])):
        t, b, _ = x.shape
        da = np.zeros((t, b, 4 * HIDDEN), np.float32)
        dwh = np.zeros_like(w[d + "h"])
        dh = dc = np.zeros((b, HIDDEN), np.float32)
        for i in range(t - 1, -1, -1) if d == "f" else range(t):
            h, c, gate, g, tc, m = kept[i]
            dh = dh + dh_all[i]
            i_, f_, o_ = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            dhm = dh * m
            dcm = dc * m + dhm * o_ * (1 - tc**2)
            da[i] = np.concatenate([dcm * g * i_ * (1 - i_), dcm * c * f_ * (1 - f_), dhm * tc * o_ * (1 - o_), dcm * i_ * (1 - g**2)], axis=1)
            dwh += h.T @ da[i]
            dh = da[i] @ w[d + "h"].T + dh * (1 - m)
            dc = dcm * f_ + dc * (1 - m)
        out[d + "x"], out[d + "h"], out[d + "_b"] = np.einsum("tbd,tbk->dk", x, da, optimize=True), dwh, da.sum((0, 1))
    return loss, out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, page, WIDTH) and the mask of what is there."""
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), WIDTH), np.float32), np.zeros((t, len(pages)), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, 1
    return x, mask


STORED = Path(__file__).with_suffix(".npz")


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    """The stored weights."""
    with np.load(STORED) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def fit(seed: int) -> dict[str, np.ndarray]:
    """The weights after EPOCHS over PAGES made pages; the same for a seed."""
    data = [e for e in map(example, range(PAGES)) if len(e[0])]
    w, r = start(seed), random.Random(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    total = EPOCHS * (len(data) // BATCH + 1)
    for _ in range(EPOCHS):
        r.shuffle(data)
        # Pages of like lengths share a batch.
        order = [sorted(data[a : a + 5 * BATCH], key=lambda e: len(e[0])) for a in range(0, len(data), 5 * BATCH)]
        flat = [e for part in order for e in part]
        for a in range(0, len(flat), BATCH):
            part = flat[a : a + BATCH]
            x, mask = padded([e[0] for e in part])
            y = np.zeros_like(mask)
            for i, e in enumerate(part):
                y[: len(e[1]), i] = e[1]
            _, g = gradients(w, x, y, mask)
            step += 1
            size = np.sqrt(sum(float((q**2).sum()) for q in g.values()))
            rate = RATE * (1 - step / (total + 1))
            for k, q in g.items():
                q = q * min(1.0, 1.0 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q**2
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in w.items()}


def label(w: dict, pages: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
    """For each page's features, which blocks are main text.  Pages of like lengths share a batch of at most ``cells``."""
    out: list = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    while order:
        n = max(1, cells // len(pages[order[-1]]))
        part, order = order[-n:], order[:-n]
        x, mask = padded([pages[i] for i in part])
        p, _ = forward(w, x, mask)
        for j, i in enumerate(part):
            out[i] = p[: len(pages[i]), j] >= 0.5
    return out


if __name__ == "__main__":
    np.savez_compressed(STORED, **fit(1))
