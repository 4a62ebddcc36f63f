"""Part of the meridia engine."""
