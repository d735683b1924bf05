"""Part of hyperloom; see the README."""
