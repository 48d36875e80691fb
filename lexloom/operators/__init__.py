"""Table operators: everything that filters, orders, packs, samples or aggregates rows."""
