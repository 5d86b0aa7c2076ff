"""Advances and texts of the fourteen standard fonts."""

from __future__ import annotations

import unicodedata

# Advances of the characters from space to tilde, from Adobe's public metrics.
ASCII = {
    "Helvetica": "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584",
    "Helvetica-Bold": "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584",
    "Times-Roman": "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541",
    "Times-Bold": "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520",
    "Times-Italic": "250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541",
    "Times-BoldItalic": "250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570",
}
# Advances of further characters, from the same metrics; accented letters are as wide as their base letter.
OTHERS = {
    "Helvetica": "¡333 ¢556 £556 ¤556 ¥556 ¦260 §556 ¨333 ©737 ª370 «556 ¬584 ®737 ¯333 °400 ±584 ²333 ³333 ´333 µ556 ¶537 ·278 ¸333 ¹333 º365 »556 ¼834 ½834 ¾834 ¿611 Æ1000 Ð722 ×584 Ø778 Þ667 ß611 æ889 ð556 ÷584 ø611 þ556 ı278 Ł556 ł222 Œ1000 œ944 ƒ556 ˆ333 ˜333 –556 —1000 ‘222 ’222 ‚222 “333 ”333 „333 †556 ‡556 •350 …1000 ‰1000 ‹333 ›333 ⁄167 €556 ™1000 −584 ﬁ500 ﬂ500",
    "Helvetica-Bold": "¡333 ¢556 £556 ¤556 ¥556 ¦280 §556 ¨333 ©737 ª370 «556 ¬584 ®737 ¯333 °400 ±584 ²333 ³333 ´333 µ611 ¶556 ·278 ¸333 ¹333 º365 »556 ¼834 ½834 ¾834 ¿611 Æ1000 Ð722 ×584 Ø778 Þ667 ß611 æ889 ð611 ÷584 ø611 þ611 ı278 Ł611 ł278 Œ1000 œ944 ƒ556 ˆ333 ˜333 –556 —1000 ‘278 ’278 ‚278 “500 ”500 „500 †556 ‡556 •350 …1000 ‰1000 ‹333 ›333 ⁄167 €556 ™1000 −584 ﬁ611 ﬂ611",
    "Times-Roman": "¡333 ¢500 £500 ¤500 ¥500 ¦200 §500 ¨333 ©760 ª276 «500 ¬564 ®760 ¯333 °400 ±564 ²300 ³300 ´333 µ500 ¶453 ·250 ¸333 ¹300 º310 »500 ¼750 ½750 ¾750 ¿444 Æ889 Ð722 ×564 Ø722 Þ556 ß500 æ667 ð500 ÷564 ø500 þ500 ı278 Ł611 ł278 Œ889 œ722 ƒ500 ˆ333 ˜333 –500 —1000 ‘333 ’333 ‚333 “444 ”444 „444 †500 ‡500 •350 …1000 ‰1000 ‹333 ›333 ⁄167 €500 ™980 −564 ﬁ556 ﬂ556",
    "Times-Bold": "¡333 ¢500 £500 ¤500 ¥500 ¦220 §500 ¨333 ©747 ª300 «500 ¬570 ®747 ¯333 °400 ±570 ²300 ³300 ´333 µ556 ¶540 ·250 ¸333 ¹300 º330 »500 ¼750 ½750 ¾750 ¿500 Æ1000 Ð722 ×570 Ø778 Þ611 ß556 æ722 ð500 ÷570 ø500 þ556 ı278 Ł667 ł278 Œ1000 œ722 ƒ500 ˆ333 ˜333 –500 —1000 ‘333 ’333 ‚333 “500 ”500 „500 †500 ‡500 •350 …1000 ‰1000 ‹333 ›333 ⁄167 €500 ™1000 −570 ﬁ556 ﬂ556",
    "Times-Italic": "¡389 ¢500 £500 ¤500 ¥500 ¦275 §500 ¨333 ©760 ª276 «500 ¬675 ®760 ¯333 °400 ±675 ²300 ³300 ´333 µ500 ¶523 ·250 ¸333 ¹300 º310 »500 ¼750 ½750 ¾750 ¿500 Æ889 Ð722 ×675 Ø722 Þ611 ß500 æ667 ð500 ÷675 ø500 þ500 ı278 Ł556 ł278 Œ944 œ667 ƒ500 ˆ333 ˜333 –500 —889 ‘333 ’333 ‚333 “556 ”556 „556 †500 ‡500 •350 …889 ‰1000 ‹333 ›333 ⁄167 €500 ™980 −675 ﬁ500 ﬂ500",
    "Times-BoldItalic": "¡389 ¢500 £500 ¤500 ¥500 ¦220 §500 ¨333 ©747 ª266 «500 ¬606 ®747 ¯333 °400 ±570 ²300 ³300 ´333 µ576 ¶500 ·250 ¸333 ¹300 º300 »500 ¼750 ½750 ¾750 ¿500 Æ944 Ð722 ×570 Ø722 Þ611 ß500 æ722 ð500 ÷570 ø500 þ500 ı278 Ł611 ł278 Œ944 œ722 ƒ500 ˆ333 ˜333 –500 —1000 ‘333 ’333 ‚333 “500 ”500 „500 †500 ‡500 •350 …1000 ‰1000 ‹333 ›333 ⁄167 €500 ™1000 −606 ﬁ556 ﬂ556",
}
# The Symbol font's own encoding, from code 32 and from code 161, each text with its advance.
SYMBOL = {
    32: " 250|!333|∀713|#500|∃549|%833|&778|∋439|(333|)333|∗500|+549|,250|−549|.250|/278|0500|1500|2500|3500|4500|5500|6500|7500|8500|9500|:278|;278|<549|=549|>549|?444|≅549|Α722|Β667|Χ722|Δ612|Ε611|Φ763|Γ603|Η722|Ι333|ϑ631|Κ722|Λ686|Μ889|Ν722|Ο722|Π768|Θ741|Ρ556|Σ592|Τ611|Υ690|ς439|Ω768|Ξ645|Ψ795|Ζ611|[333|∴863|]333|⊥658|_500|‾500|α631|β549|χ549|δ494|ε439|φ521|γ411|η603|ι329|ϕ603|κ549|λ549|µ576|ν521|ο549|π549|θ521|ρ549|σ603|τ439|υ576|ϖ713|ω686|ξ493|ψ686|ζ494|{480|‖200|}480|∼549",
    161: "ϒ620|′247|≤549|⁄167|∞713|ƒ500|♣753|♦753|♥753|♠753|↔1042|←987|↑603|→987|↓603|°400|±549|″411|≥549|×549|∝713|∂494|•460|÷549|≠549|≡549|≈549|…1000|⏐603|⎯1000|↵658|ℵ823|ℑ686|ℜ795|℘987|⊗768|⊕768|∅823|∩768|∪768|⊃713|⊇713|⊄713|⊂713|⊆713|∈713|∉713|∠768|∇713|®790|©790|™890|∏823|√549|⋅250|¬713|∧603|∨603|⇔1042|⇐987|⇑603|⇒987|⇓603|◊494|⟨329|®790|©790|™786|∑713|⎛384|⎜384|⎝384|⎡384|⎢384|⎣384|⎧494|⎨494|⎩494|⎪494",
}
# Advances of ZapfDingbats from code 32 and from code 161; its signs follow Unicode's block of dingbats but for a few.
DINGBATS = {
    32: "278 974 961 974 980 719 789 790 791 690 960 939 549 855 911 933 911 945 974 755 846 762 761 571 677 763 760 759 754 494 552 537 577 692 786 788 788 790 793 794 816 823 789 841 823 833 816 831 923 744 723 749 790 792 695 776 768 792 759 707 708 682 701 826 815 789 789 707 687 696 689 786 787 713 791 785 791 873 761 762 762 759 759 892 892 788 784 438 138 277 415 392 392 668 668",
    161: "732 544 544 910 667 760 760 776 595 694 626 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 788 894 838 1016 458 748 924 748 918 927 928 928 834 873 828 924 924 917 930 931 463 883 836 836 867 867 696 696 874 0 874 760 946 771 865 771 888 967 888 831 873 927 970 918",
}
# Signs of ZapfDingbats outside the block of dingbats, by code.
DINGBAT_TEXTS = {32: " ", 37: "☎", 42: "☛", 43: "☞", 72: "★", 108: "●", 110: "■", 115: "▲", 116: "▼", 117: "◆", 119: "◗", 168: "♣", 169: "♦", 170: "♥", 171: "♠", 172: "①", 173: "②", 174: "③", 175: "④", 176: "⑤", 177: "⑥", 178: "⑦", 179: "⑧", 180: "⑨", 181: "⑩", 213: "→", 214: "↔", 215: "↕"}
# How far glyphs go below the baseline.
DESCENTS = {"Helvetica": -207.0, "Times": -217.0, "Courier": -157.0}


def face(name: str) -> str | None:
    """The standard font that a base font's name, subset mark and all, stands for."""
    plain = name.split("+")[-1].replace(" ", "")
    if plain.startswith("Symbol"):
        return "Symbol"
    if plain.startswith(("ZapfDingbats", "Zapf")):
        return "ZapfDingbats"
    bold, slanted = "Bold" in plain, "Italic" in plain or "Oblique" in plain
    if plain.startswith("Courier"):
        return "Courier"
    if plain.startswith(("Helvetica", "Arial")):
        return "Helvetica-Bold" if bold else "Helvetica"
    if plain.startswith("Times"):
        return "Times-BoldItalic" if bold and slanted else "Times-Bold" if bold else "Times-Italic" if slanted else "Times-Roman"
    return None


def advances(name: str) -> dict[str, float]:
    """Advances by text; of an accented letter that of its base, a dotless i's for an accented i."""
    out = {chr(32 + i): float(w) for i, w in enumerate(ASCII[name].split())}
    out |= {x[0]: float(x[1:]) for x in OTHERS[name].split()}
    for code in range(0xC0, 0x180):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) == 2 and base[0] in out:
            out.setdefault(chr(code), out["ı" if base[0] == "i" else base[0]])
    return out | {" ": out[" "], "­": out["-"]}


def own_encoding(name: str) -> tuple[dict[int, str], dict[int, float]]:
    """Texts and advances by code of the two fonts that have their own encoding."""
    if name == "Symbol":
        rows = [(code + i, x[0], float(x[1:])) for code, part in SYMBOL.items() for i, x in enumerate(part.split("|"))]
        rows += [(160, "€", 750.0), (241, "⟩", 329.0), (242, "∫", 274.0), (243, "⌠", 686.0), (244, "⎮", 686.0), (245, "⌡", 686.0)]
        rows += [(246 + i, t, 494.0 if i > 5 else 384.0) for i, t in enumerate("⎞⎟⎠⎤⎥⎦⎫⎬⎭")]
        return {c: t for c, t, _ in rows}, {c: w for c, _, w in rows}
    widths = {code + i: float(w) for code, part in DINGBATS.items() for i, w in enumerate(part.split())}
    # codes 33 to 126 and 161 to 254 stand for U+2701 to U+275E and U+2761 to U+27BE
    return {c: DINGBAT_TEXTS.get(c, chr(0x2701 + c - 33 if c < 160 else 0x2761 + c - 161)) for c in widths}, widths
