"""Writers: trees to text formats, by a style per format."""

from __future__ import annotations

from ..model import Document


def write(fmt: str, doc: Document) -> str | bytes:
    """``doc`` in ``fmt``; what a format cannot say falls back to its content."""
    from . import containers, slides, styles, tables, tree

    if fmt in tables.WRITERS:
        return tables.WRITERS[fmt](doc)
    if fmt in slides.WRITERS:
        return slides.WRITERS[fmt](doc)
    if fmt in tree.WRITERS:
        return tree.WRITERS[fmt](doc)
    if fmt in containers.WRITERS:
        return containers.WRITERS[fmt](doc)
    if fmt in styles.STYLES:
        return styles.emit(styles.STYLES[fmt], doc)
    raise ValueError(f"unsupported format: {fmt}")


def formats() -> list[str]:
    from . import containers, slides, styles, tables, tree

    return sorted({*tables.WRITERS, *slides.WRITERS, *tree.WRITERS, *containers.WRITERS, *styles.STYLES})
