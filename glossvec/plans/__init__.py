"""Physical-plan helpers: size-checked joins and ordered numbering without a global window."""
