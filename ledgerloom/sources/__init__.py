"""Sources: filters in two dialects, readers by URI, scoped loads and previews, range helpers, the registry, evidence."""
