"""Where rows come from: tables, directory trees, file contents and change streams."""
