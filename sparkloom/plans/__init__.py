from . import audits, catalog, scaled  # noqa: F401  (audits and scaled add their queries to the catalogue)
