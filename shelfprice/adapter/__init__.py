"""Maps star-schema tables onto the price model, with the matching SQL for checks."""
