"""Where twins come from: relational tables, stored twins, machine packs and generators."""
