"""Query language: tokens, parser, registry, compiler."""
