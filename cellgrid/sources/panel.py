"""Panels: which metal or fluorophore and which antigen a channel stands for."""

from __future__ import annotations

import re

#: Symbols of the elements that label antibodies or calibrate instruments.
ELEMENTS = "In Pd Cd Te I Xe Cs Ba La Ce Pr Nd Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Ta Ir Pt Bi Pb Rh Os Y Sn Ag Ru"
METAL = re.compile(r"(?<![A-Za-z])(?:(" + "|".join(ELEMENTS.split()) + r")(\d{2,3})|(\d{2,3})(" + "|".join(ELEMENTS.split()) + r"))(?![a-z])")
#: What channels have around their names that is no part of them.
EDGES = re.compile(r"^[\W_]+|[\W_]+$|[()]|Di\b")


def metal_in(text: str) -> str:
    """The element and mass in a text, as Nd142; empty if there is none."""
    m = METAL.search(text)
    return (m[1] or m[4]) + (m[2] or m[3]) if m else ""


def split_channel(name: str, described: str) -> tuple[str, str]:
    """(metal, antigen) from a parameter's name and description."""
    metal = metal_in(name) or metal_in(described) or name
    antigen = described
    m = METAL.search(described)
    if m:
        antigen = described[: m.start()] + described[m.end() :]
    antigen = EDGES.sub("", EDGES.sub("", antigen)).strip()
    return metal, antigen or "empty"


def panel_of(names: list[str], described: list[str]) -> list[tuple[str, str]]:
    """(metal, antigen) of each channel; without any description the name stands for both."""
    return [split_channel(n, s) if s else ((metal_in(n) or n), n if not metal_in(n) else "empty") for n, s in zip(names, described, strict=True)]


def channel_name(antigen: str, metal: str, sep: str = "|") -> str:
    return antigen if antigen == metal else f"{antigen}{sep}{metal}"
