"""DataFrame -> DataFrame operators (parse, lines, stats, compact, prompt,
respond, catalog, repos, release) and the skew-safe ranking helper."""
