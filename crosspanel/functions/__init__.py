"""Column functions over a panel: element by element, along time, across a date."""
