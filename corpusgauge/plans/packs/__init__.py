"""Built-in rule packs by name."""

from . import css, html, javascript, mongodb, python, react

PACKS = {
    **html.PACKS, **javascript.PACKS, **mongodb.PACKS, **python.PACKS, **react.PACKS, **css.PACKS,
}
